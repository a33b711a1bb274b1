"""Problem 4: text of scanned pages repaired into whole paragraphs.

Page furniture is told by a decision tree over page-position features of a line: its place between page
breaks, blank lines and the text's ends, whether its number counts on with others a page apart, how much
like other lines, the title or the author it is, and its shape. The tree is trained on pages set from clean
texts, with heads, feet, numbers and headings of common make.

Words are repaired by a character editor: an averaged perceptron that predicts for every character read to
keep, replace or delete it, to insert others beside it and, at a line's end, to join the line to the next
with or without the mark. Its operations are learnt by aligning the scans of a bounded sample of documents
(``TRAIN_TEXTS``, the lowest hashes) with the clean texts of the same documents; beyond them, one operation
a word may be any letter of the alphabet. Every distinct unknown word of the corpus is decoded once, over a
trie of the words of all clean texts. The lexicon is never cut: it goes to the decoding tasks in blocks of
``LEXICON_BLOCK`` words, unknown words meet every block, and the best score over the blocks holds.

Defined results: null and empty texts have no lines; null titles and authors are no features; form
feeds are page breaks; a doc_id delivered twice counts once; words that neither the lexicon nor
the editor knows stay as they are; without clean texts nothing is misread.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.main_body import Tree
from quillmill.runtime import ship, staged

ship(__name__)
ship("quillmill.llm.main_body")
ship("quillmill.llm.common_words")

#: Documents whose scans are aligned with their clean texts, words the editor is trained on, rounds.
TRAIN_TEXTS, TRAIN_WORDS, EPOCHS = 300, 4_000, 2
#: Words of the lexicon and unknown words that one decoding task holds.
LEXICON_BLOCK, QUERY_BLOCK = 100_000, 10_000
#: Words of books' structure, which running text may lack.
STRUCTURE = "chapter part section introduction preface contents appendix notes".split()
MARKS = "-‐\xad¬"
LEAD, TRAIL = "“”\"'([‘«—–", "“”\"')]’»,.?!;:…—–"
_WORD = r"^\p{L}(?:[\p{L}'’-]*\p{L})?$"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def core(token: str) -> str:
    """A token without the punctuation around it."""
    return token.lstrip(LEAD).rstrip(TRAIL)


# The editor


def outputs(read: str, true: str) -> list[str]:
    """What each character read stands for, by the alignment of the two words."""
    out = [""] * len(read)
    for tag, a, b, c, d in SequenceMatcher(None, read, true, False).get_opcodes() if read else ():
        if tag == "equal":
            for k in range(b - a):
                out[a + k] += read[a + k]
        elif tag == "replace":
            if b - a == d - c:
                for k in range(b - a):
                    out[a + k] += true[c + k]
            else:
                out[a] += true[c:d]
        elif tag == "insert":
            if a == 0:
                out[0] = true[c:d] + out[0]
            else:
                out[a - 1] += true[c:d]
    return out


class Editor:
    """The averaged-perceptron character editor over a lexicon."""

    BEAM = 16

    def __init__(self, lexicon: Iterable[str], by: dict[str, list[str]] | None = None, weights: dict[str, dict[str, float]] | None = None, judge: Tree | None = None):
        self.lexicon = frozenset(lexicon)
        self.judge = judge
        kids: dict[str, set[str]] = {"": set()}
        for w in self.lexicon:
            for i in range(len(w)):
                kids.setdefault(w[:i], set()).add(w[i])
            kids.setdefault(w, set())
        self.kids = {p: "".join(sorted(k)) for p, k in kids.items()}
        #: outputs learnt for a character; "\n" is a line's end after a mark
        self.by = by or {"\n": ["", "-"]}
        self.weights = weights or {}

    @staticmethod
    def contexts(word: str, i: int) -> list[str]:
        p = "^^" + word + "$$"
        j = i + 2
        return [f"0{p[j]}", f"1{p[j - 1 : j + 1]}", f"2{p[j : j + 2]}", f"3{p[j - 1 : j + 2]}", f"4{p[j - 2 : j + 1]}", f"5{p[j : j + 3]}"]

    def _table(self, word: str, marks: list[str]) -> list[dict[str, float]]:
        """Per position the score of every operation."""
        out = []
        for i, ch in enumerate(word):
            got: dict[str, float] = defaultdict(float)
            for f in self.contexts(word, i) + (marks if ch == "\n" else []):
                for op, v in self.weights.get(f, {}).items():
                    got[op] += v
            out.append(got)
        return out

    def _lex(self, name: str) -> float:
        return self.weights.get(name, {}).get("*", 0.0)

    def _steps(self, ch: str, prefix: str, any_: bool, last: bool) -> Iterator[tuple[str, str]]:
        """(operation, output) pairs; operations on any letter are limited to the trie's next letters."""
        if ch != "\n":
            yield "k", ch
        known = self.by.get(ch, ())
        for o in known:
            yield "=" + o, o
        if any_ and ch != "\n":
            kids = self.kids.get(prefix, "")
            yield "D", ""
            for c in kids:
                if c != ch and c not in known:
                    yield "R", c
                if ch in self.kids.get(prefix + c, ""):
                    yield "I", c + ch
            if last:
                for c in self.kids.get(prefix + ch, ""):
                    yield "A", ch + c

    def decode(self, word: str, marks: list[str] | None = None, any_: bool = False) -> list[tuple[float, str, tuple[int, ...]]]:
        """(score, lexicon word, positions edited) of the word's best readings in the lexicon, best first.

        The trie's prefix and whether the free operation is spent make up the state, so equal states merge.
        """
        table = self._table(word, marks or [])
        trie, end_word = self._lex("trie"), self._lex("word")
        states: dict[tuple[str, bool], tuple[float, tuple[int, ...]]] = {("", False): (0.0, ())}
        for i, ch in enumerate(word):
            last = i == len(word) - 1
            grown: dict[tuple[str, bool], tuple[float, tuple[int, ...]]] = {}
            scores = table[i]
            for (prefix, spent), (score, edits) in states.items():
                for op, out in self._steps(ch, prefix, any_ and not spent, last):
                    new = prefix + out
                    if new not in self.kids:
                        continue
                    s = score + scores.get(op, 0.0) + trie
                    key = (new, spent or op in "RIDA")
                    if key not in grown or s > grown[key][0]:
                        grown[key] = (s, edits if op == "k" or ch == "\n" else (*edits, i))
            if len(grown) > self.BEAM:
                grown = dict(sorted(grown.items(), key=lambda g: -g[1][0])[: self.BEAM])
            states = grown
        best: dict[str, tuple[float, tuple[int, ...]]] = {}
        for (w, _), (s, e) in states.items():
            if w in self.lexicon and (w not in best or s + end_word > best[w][0]):
                best[w] = (s + end_word, e)
        return sorted(((s, w, e) for w, (s, e) in best.items()), key=lambda g: (-g[0], g[1]))

    def kept(self, word: str, marks: list[str] | None = None, join: str | None = None) -> float:
        """The score of the word as it was read; ``join`` is what becomes of a line's end."""
        s, prefix = 0.0, ""
        for ch, scores in zip(word, self._table(word, marks or [])):
            s += scores.get("k" if ch != "\n" else "=" + (join or ""), 0.0)
            prefix += ch if ch != "\n" else (join or "")
            s += self._lex("trie" if prefix in self.kids else "no-trie")
        return s + self._lex("word" if prefix in self.lexicon else "no-word")

    def reading(self, word: str) -> tuple[float, str, tuple[int, ...], list[float]] | None:
        """(gain of the operations, lexicon word, positions edited, what the judge is told) of the best reading with edits."""
        for any_ in (False, True):
            found = next((g for g in self.decode(word, None, any_) if g[2]), None)
            if found:
                s, w, e = found
                # what the edits cost beside keeping every character, the lexicon aside
                n = len(word)
                gain = s - self._lex("word") - n * self._lex("trie") - sum(t.get("k", 0.0) for t in self._table(word, []))
                return gain, w, e, [gain, gain / len(e), len(e) / n, n, float(any_)]
        return None

    def repair(self, word: str) -> tuple[str, tuple[int, ...], float]:
        """(word, positions edited, gain over keeping it); a known word, or one nothing is known of, is kept."""
        if word in self.lexicon:
            return word, (), 0.0
        got = self.reading(word)
        if got and (self.judge is None or self.judge.predict(np.array([got[3]], np.float32))[0]):
            return got[1], got[2], got[0]
        return word, (), 0.0

    def judged(self, words: list[str], by: dict[str, list[tuple[str, int]]], seed: int = 9, rounds: int = 4000) -> Editor:
        """Trains the judge of readings: misread words whose truth the lexicon has, against words that it lacks."""
        r = random.Random(seed)
        words = sorted(words)
        lacks = set(r.sample(words, len(words) // 12))
        small = Editor([w for w in words if w not in lacks], self.by, self.weights)
        x, y = [], []
        for w in r.choices(words, k=rounds) if words else []:
            read = w if w in lacks else noised(w, by, r, 0.12, 0.4)[0]
            got = small.reading(read) if read and read not in small.lexicon else None
            if got:
                x.append(got[3])
                y.append(got[1] == w)
        self.judge = Tree().fit(np.array(x, np.float32), np.array(y), 4, 20) if x and any(y) else None
        return self

    def joined(self, a: str, b: str, marks: list[str]) -> tuple[float, str, str, tuple[int, ...]]:
        """(score, "" or "-", whole word, positions of edits in a + line's end + b)."""
        word = a + "\n" + b
        out = []
        for any_ in (False, True):
            for s, w, e in self.decode(word, marks, any_):
                cut = "-" if w.count("-") > (a + b).count("-") else ""
                out.append((s, cut, w, e))
            if out:
                break
        for cut in ("", "-"):
            out.append((self.kept(word, marks, cut), cut, a + cut + b, ()))
        return max(out, key=lambda g: (g[0], g[2] in self.lexicon, g[1] == ""))

    def train(self, examples: list[tuple[str, list[str], list[str]]], seen: list[tuple[str, list[str], list[str]]] | None = None, absent: float = 0.04, seed: int = 5) -> Editor:
        """Examples: (word read, outputs, marks of the line's end). Operations are those of the ``seen`` ones
        (all by default), the rest goes as operations on any letter; a share of words is taken for absent from the lexicon."""
        r = random.Random(seed)
        counts = Counter((ch, o) for word, outs, _ in (examples if seen is None else seen) for ch, o in zip(word, outs) if o != ch)
        by = defaultdict(list, {"\n": ["", "-"]})
        for (ch, o), n in sorted(counts.items()):
            if n > 2 and ch != "\n" and len(o) <= 2 and o not in by[ch]:
                by[ch].append(o)
        self.by = dict(by)
        total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        stamp: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.weights = weights
        clock = 0

        def bump(f: str, op: str, v: float) -> None:
            total[f][op] += (clock - stamp[f][op]) * weights[f][op]
            stamp[f][op] = clock
            weights[f][op] += v

        def name(ch: str, o: str) -> str:
            if ch == "\n" or o in self.by.get(ch, ()):
                return "=" + o
            return "k" if o == ch else "D" if not o else "I" if o.endswith(ch) else "A" if o.startswith(ch) else "R"

        for _ in range(EPOCHS):
            for word, outs, marks in examples:
                hidden = r.random() < absent and "".join(outs) == word
                done = ""
                free = True
                wide = r.random() < 0.15 or any(name(c, o) in "RIDA" for c, o in zip(word, outs))
                for i, ch in enumerate(word):
                    clock += 1
                    feats = self.contexts(word, i) + (marks if ch == "\n" else [])
                    end = i == len(word) - 1
                    want = (name(ch, outs[i]), outs[i])
                    options = {want, *self._steps(ch, done, wide and free, end)}
                    options |= {("k", ch)} if ch != "\n" else set()
                    known = lambda out: not hidden and done + out in self.kids  # noqa: B023, E731

                    def lexical(out: str) -> list[str]:
                        got = ["trie" if known(out) else "no-trie"]  # noqa: B023
                        return [*got, "word" if known(out) and done + out in self.lexicon else "no-word"] if end else got  # noqa: B023

                    score = lambda o: sum(weights[f].get(o[0], 0.0) for f in feats if f in weights) + sum(weights[f].get("*", 0.0) for f in lexical(o[1]) if f in weights)  # noqa: B023, E731
                    best = max(sorted(options), key=score)
                    if best != want:
                        for f in feats:
                            bump(f, want[0], 1.0)
                            bump(f, best[0], -1.0)
                        for f in lexical(want[1]):
                            bump(f, "*", 1.0)
                        for f in lexical(best[1]):
                            bump(f, "*", -1.0)
                    done += outs[i]
                    free = free and want[0] not in "RIDA"
        self.weights = {f: {o: (total[f][o] + (clock - stamp[f][o]) * v) / max(1, clock) for o, v in ws.items()} for f, ws in weights.items()}
        return self


def marks_of(mark: str, ka: bool, kb: bool, hyphen: bool) -> list[str]:
    """Features of a line's end: its mark, whether both parts are words, whether the first has a hyphen."""
    return [f"m{mark}", f"w{ka:d}{kb:d}", f"h{hyphen:d}", f"mw{mark}{ka:d}{kb:d}{hyphen:d}"]


def noised(word: str, by: dict[str, list[tuple[str, int]]], r: random.Random, rate: float = 0.12, free: float = 0.25) -> tuple[str, list[str]]:
    """The word misread at random: by confusions (true characters -> (read, count)), or once by any letter."""
    read: list[str] = []
    outs: list[str] = []
    i = 0
    spot = r.randrange(len(word)) if r.random() < free else -1
    while i < len(word):
        if i == spot:
            kind = r.choice("RID")
            if kind == "R":
                read.append(r.choice(_LETTERS))
                outs.append(word[i])
            elif kind == "I":
                read.append(r.choice([word[i], r.choice(_LETTERS)]))
                outs.append("")
                read.append(word[i])
                outs.append(word[i])
            elif i + 1 < len(word):
                # a letter lost: the next one stands for both
                read.append(word[i + 1])
                outs.append(word[i : i + 2])
                i += 1
            else:
                read.append(word[i])
                outs.append(word[i])
            i += 1
            continue
        options = [(t, x, n) for k in (1, 2) for t in [word[i : i + k]] if len(t) == k for x, n in by.get(t, ())] if r.random() < rate else []
        if options:
            t, x, _ = r.choices(options, [n for _, _, n in options])[0]
            read += x
            outs += [t] + [""] * (len(x) - 1)
            i += len(t)
        else:
            read.append(word[i])
            outs.append(word[i])
            i += 1
    return "".join(read), outs


# Alignment of scans with clean texts


def aligned(scan: str, clean: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, read, true, mark): kind w for a word of a scan and the clean word it stands for, j for a word divided at a line's end.

    A line is anchored by three consecutive words that the clean text has; its other words stand by their places.
    """
    words = [core(t).lower() for t in clean.split()]
    at: dict[tuple[str, ...], int] = {}
    twice: set[tuple[str, ...]] = set()
    for k in range(len(words) - 2):
        key = tuple(words[k : k + 3])
        if key in at:
            twice.add(key)
        at[key] = k
    lines = [x.replace("\f", " ").split() for x in scan.split("\n")]
    lines = [x for x in lines if x]
    for n, row in enumerate(lines):
        low = [core(t).lower() for t in row]
        where = next((at[key] - k for k in range(len(low) - 2) for key in [tuple(low[k : k + 3])] if key in at and key not in twice), None)
        if where is None:
            continue
        for k, w in enumerate(low):
            if not 0 <= where + k < len(words) or (k == 0 and n and lines[n - 1][-1][-1:] in MARKS):
                continue
            true = words[where + k]
            if k == len(low) - 1 and row[k][-1:] in MARKS and len(row[k]) > 1:
                a = row[k].lstrip(LEAD)[:-1].lower()
                rest = next((core(x[0]).lower() for x in lines[n + 1 : n + 4] if x and _like(a + core(x[0]).lower(), true.replace("-", ""))), None)
                if rest and a:
                    yield "j", a + "\n" + rest, true, row[k][-1]
            elif w and true and (w == true or (_like(w, true) and any(c.isalpha() for c in w))):
                yield "w", w, true, ""


def _like(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= 2 and SequenceMatcher(None, a, b, False).ratio() >= 0.6


def examples_of(pairs: list[tuple[str, str]]) -> tuple[list[tuple[str, list[str], list[str]]], dict[str, list[tuple[str, int]]], list[str]]:
    """(editor's examples, confusions true -> (read, count), clean words) of (scan, clean text) pairs."""
    words, ends = Counter(), Counter()
    for scan, clean in pairs:
        for kind, read, true, mark in aligned(scan, clean):
            (ends if kind == "j" else words)[read, true, mark] += 1
    vocabulary = {t for _, t, _ in words}
    confusions: Counter = Counter()
    examples = []
    for (read, true, _), n in sorted(words.items()):
        outs = outputs(read, true)
        if read != true:
            examples += [(read, outs, [])] * min(n, 3)
            for tag, a, b, c, d in SequenceMatcher(None, read, true, False).get_opcodes():
                if tag == "replace" and d - c <= 2 and b - a <= 2:
                    confusions[true[c:d], read[a:b]] += n
    for (read, true, mark), n in sorted(ends.items()):
        a, b = read.split("\n")
        plain = true == a + b or true == a + "-" + b
        marks = marks_of(mark, a in vocabulary, b in vocabulary, "-" in a)
        if plain:
            outs = [*a, "-" if true != a + b else "", *b]
            examples += [(read, outs, marks)] * min(n, 3)
    by: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for (t, x), n in sorted(confusions.items()):
        if n > 1:
            by[t].append((x, n))
    return examples, dict(by), sorted(vocabulary)


# Page furniture

NAMES = (
    "words chars relative digits letters upper stop lower hyphen kind partners step near_number blank_above blank_below feed from_start from_end title author alike alike_far "
    "alike_gap n_kind p_kind n_title p_title n_alike p_alike spaces dash first_alike"
).split()
_DIGIT = str.maketrans("lI|!íOoSsZBgq", "1111100552899")
_NUMBER = r"[0-9lI|!OoSsZBgqí]+"
_ALONE = re.compile(rf"^[\W_]*(?:p(?:age|g)?\s*\.?\s*)?({_NUMBER})(?:\s*(?:of|/)\s*{_NUMBER})?[\W_]*$", re.I)
_DRESSED = re.compile(r"^(?:p(?:age|g)?\b|[-–—•\[(*~|]\s*\w)", re.I)
_AFTER = re.compile(rf"^(\D.*?)(?:\s{{2,}}|\s+[|·•/—–]\s+)({_NUMBER})\.?$")
_BEFORE = re.compile(rf"^({_NUMBER})\.?(?:\s{{2,}}|\s+[|·•/—–]\s+)(.*\D)$")
_ROMAN = re.compile(r"^[\W_]*(?:p(?:age|g)?\s*\.?\s*)?([ivxlcdm1|!]+)[\W_]*$")
_WORTH = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_FIGURE = re.compile(r"\d")
_DIMS = 512


def _value(s: str) -> int | None:
    if not any(c.isdigit() for c in s):
        return None
    v = s.translate(_DIGIT)
    return int(v) if v.isdigit() and len(v) < 10 else None


def _roman(s: str) -> int | None:
    m = _ROMAN.match(s)
    if not m or not any(c in "ivxlcdm" for c in m[1]):
        return None
    vals = [_WORTH.get(c, 1) for c in m[1]]
    return sum(-v if v < max(vals[k + 1 :], default=0) else v for k, v in enumerate(vals))


_OTHER = re.compile(r"[^\w\n]+|[\d_]+")


def _bare(s: str) -> str:
    """Letters alone (and line feeds), figures and marks that are read for letters as those letters."""
    s = s.lower()
    for a, b in zip("0516!|", "oslbii"):
        s = s.replace(a, b)
    return _OTHER.sub("", s if s.isascii() else unicodedata.normalize("NFKD", s))


def _name(s: str | None) -> str:
    return _bare((s or "").replace("\n", " "))


def _grams(texts: list[str]) -> np.ndarray:
    """Unit vectors of hashed character bigrams."""
    n = len(texts)
    size = np.array([len(t.encode("utf-16-le")) // 2 for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-16-le"), np.uint16).astype(np.int64)
    # a mark before and after every text
    codes = np.insert(np.insert(codes, np.cumsum(size), 36), np.cumsum(size + 1) - size - 1, 94) if n else codes
    row = np.repeat(np.arange(n), size + 2)
    same = row[1:] == row[:-1]
    key = row[1:] * _DIMS + (codes[:-1] * 31 + codes[1:] * 7) % _DIMS
    out = np.bincount(key[same], minlength=n * _DIMS).reshape(n, _DIMS).astype(np.float32)
    out[size == 0] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


def page_features(lines: list[str], title: str | None, author: str | None) -> tuple[list[int], np.ndarray]:
    """(numbers of the non-blank lines, one row of ``NAMES`` each)."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    n = len(filled)
    x = np.zeros((n, len(NAMES)), np.float32)
    if not n:
        return filled, x
    col = {name: k for k, name in enumerate(NAMES)}
    strip = [lines[i].strip() for i in filled]
    length = np.array([len(s) for s in strip], np.float32)
    usual = float(np.median(length))
    kind, value, text = np.zeros(n, np.float32), np.full(n, -1, np.int64), []
    rows = []
    letters = [len(t) for t in _OTHER.sub("", "\n".join(strip)).split("\n")]
    for k, s in enumerate(strip):
        figures = len(_FIGURE.findall(s))
        m = _ALONE.match(s) if figures else None
        v = _value(m[1]) if m else None
        rest = "" if v is not None else s
        if v is not None:
            kind[k] = 2 if _DRESSED.search(s) else 1
        elif (v := _roman(s)) is not None:
            kind[k], rest = 3, ""
        elif figures:
            m = _AFTER.match(s) or _BEFORE.match(s)
            if m:
                a, b = (m[1], m[2]) if m.re is _AFTER else (m[2], m[1])
                v = _value(b)
                if v is not None:
                    kind[k], rest = 4, a
        value[k] = -1 if v is None else v
        text.append(rest)
        rows.append((s.count(" ") + 1, len(s), len(s) / usual, figures / len(s), letters[k], s.isupper(), s[-1] in ".,?!;:”\"’", s[0].islower(), s[-1] in MARKS))
    text = _bare("\n".join(text)).split("\n")
    x[:, :9] = rows
    x[:, col["kind"]] = kind
    at = np.array(filled)
    # numbers that count on: the lines a page takes are the gap by the difference; partners agree on it
    num = np.flatnonzero(value >= 0)
    x[:, col["near_number"]] = 1e3
    if len(num) > 1:
        gap, diff = at[num][None, :] - at[num][:, None], value[num][None, :] - value[num][:, None]
        ok = (gap > 0) & (diff > 0) & (gap >= 6 * diff)
        if ok.any():
            step = np.where(ok, gap / np.maximum(diff, 1), np.nan)
            page = float(np.nanmedian(step))
            fits = ok & (np.abs(step - page) <= 0.4 * page)
            partners = fits.sum(0) + fits.sum(1)
            x[num, col["partners"]] = partners
            x[num, col["step"]] = np.where(partners > 0, page, 0)
            good = at[num[partners > 0]]
            if len(good):
                x[:, col["near_number"]] = np.abs(at[:, None] - good[None, :]).min(1)
    blank = np.array([not s.strip() for s in lines] + [True])
    x[:, col["blank_above"]] = [i == 0 or blank[i - 1] for i in filled]
    x[:, col["blank_below"]] = [bool(blank[i + 1]) for i in filled]
    feed = ["\f" in s for s in lines] + [False, False]
    x[:, col["feed"]] = [feed[i] or feed[i + 1] or (i > 0 and feed[i - 1]) for i in filled]
    x[:, col["from_start"]] = np.arange(n)
    x[:, col["from_end"]] = np.arange(n)[::-1]
    grams = _grams(text)
    names = [_name(title), _name(author), _name(author) + _name(title), _name(title) + _name(author)]
    to = grams @ _grams(names).T
    x[:, col["title"]] = to.max(1)
    x[:, col["author"]] = to[:, 1]
    first: dict[int, float] = {}
    for a in range(0, n, 2048):
        s = grams[a : a + 2048] @ grams.T
        far = np.abs(at[a : a + 2048, None] - at[None, :])
        s[far == 0] = 0
        near = s >= 0.7
        x[a : a + 2048, col["alike"]] = s.max(1)
        x[a : a + 2048, col["alike_far"]] = (near & (far >= 8)).sum(1)
        x[a : a + 2048, col["alike_gap"]] = np.where(near.any(1), np.where(near, far, 10**6).min(1), 1e3)
        x[a : a + 2048, col["first_alike"]] = np.where(near.any(1), near.argmax(1) > np.arange(a, min(n, a + 2048)), 0)
    for prefix, by in (("n_", 1), ("p_", -1)):
        for name in ("kind", "title", "alike"):
            v = x[:, col[name]]
            x[:, col[prefix + name]] = np.r_[v[1:], -1] if by > 0 else np.r_[-1, v[:-1]]
    x[:, col["spaces"]] = ["  " in s for s in strip]
    x[:, col["dash"]] = [any(c in s for c in "—–|·•") for s in strip]
    return filled, x


def _pages(r: random.Random, words: list[str], by: dict) -> tuple[list[str], list[bool], str, str]:
    """(lines, whether they are furniture, title, author) of some pages set from clean words."""
    cap = lambda k: " ".join(r.choice(words).capitalize() for _ in range(k))
    name = lambda: "".join(r.choice(["pal", "tor", "min", "vel", "sha", "ken"]) for _ in range(r.randrange(2, 4))).capitalize()
    title, author = r.choice([cap(2), cap(3), cap(4), f"On {cap(1)}", f"The {cap(2)}"]), f"{name()} {name()}"
    width, height, number = r.randrange(38, 78), r.randrange(12, 48), r.choice([r.randrange(1, 40), r.randrange(40, 400)])
    rate = r.choice([0.0, 0.03, 0.1, 0.2])
    noisy = lambda s: "".join(noised(w, by, r, rate, 0.0)[0] if w else "" for w in re.split(r"(\s)", s))
    romans = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi"]
    roman = r.random() < 0.1
    put = r.choice([lambda t, p: f"{t} | {p}", lambda t, p: f"{p} | {t}", lambda t, p: f"{t}   {p}", lambda t, p: f"{p}  {t}", lambda t, p: f"{t} — {p}", lambda t, p: t, lambda t, p: t])
    alone = r.choice([lambda p, q: f"{p}", lambda p, q: f"{p}", lambda p, q: f"{p}.", lambda p, q: f"- {p} -", lambda p, q: f"— {p} —", lambda p, q: f"Page {p} of {q}", lambda p, q: f"[{p}]", lambda p, q: f"p. {p}", lambda p, q: f"{p} / {q}"])
    at = r.randrange(len(words))
    chapter = " ".join((words[at : at + r.randrange(2, 8)] or words[:3])).capitalize()
    heads = r.choice([[chapter], [title, chapter], [title], [author], [title, author], [title.upper()], [author.upper(), title.upper()], [f"{author} — {title}"], [], [cap(2).upper()]])
    top, foot = r.random() < 0.7, r.random() < 0.5
    if not heads and not foot and r.random() < 0.7:
        foot = True
    credit = r.random() < 0.15
    gap_top, gap_foot, feeds = r.random() < 0.5, r.random() < 0.5, r.random() < 0.2
    lines: list[tuple[str, bool]] = []
    cut = 0
    if r.random() < 0.3:
        lines += [(noisy(f"Chapter {r.randrange(1, 30)}"), False), ("", False)]
        if r.random() < 0.5:
            lines += [(noisy(r.choice([chapter, cap(r.randrange(2, 5))])), False), ("", False)]
    for p in range(number, number + r.choice([1, 2, 3, 4, 5, 6, 8])):
        shown = romans[p % 16] if roman else str(p)
        if heads and top and not (p == number and r.random() < 0.3):
            line = put(heads[p % len(heads)], shown)
            lines += [(noisy(("\f" if feeds and p > number else "") + line), True)] + ([("", False)] if gap_top else [])
        elif feeds and p > number:
            lines.append(("\f", False))
        cut_line, room = "", height + r.randrange(-2, 3)
        while room > 0:
            if r.random() < 0.06:
                blank = [("", False)] * r.choice([0, 1, 1, 1])
                lines += [*blank, (noisy(r.choice([cap(3), f"Chapter {r.randrange(1, 30)}", str(r.randrange(1900, 2020)), f"{r.randrange(1, 9)}."])), False), *blank]
            indent = r.choice(["", "", "  ", "    "])
            for k in range(r.randrange(2, 9)):
                cut_line = "" if k else indent
                while len(cut_line) < width - 6:
                    cut_line += " " + words[cut % len(words)]
                    cut += 1 + r.randrange(3)
                cut_line = cut_line.rstrip() if indent and not k else cut_line.strip()
                if r.random() < 0.3:
                    cut_line += r.choice([".", ",", "-", ".", "?"])
                lines.append((noisy(cut_line[: r.choice([width, width, width, r.randrange(4, width)])]), False))
                room -= 1
            if r.random() < 0.6:
                # how a paragraph ends
                lines.append((noisy(" ".join(words[(cut + k) % len(words)] for k in range(r.randrange(1, 6))) + r.choice([".", ".", "?", ".”"])), False))
                room -= 1
            if r.random() < 0.5:
                lines.append(("", False))
        if foot:
            line = alone(shown, number + 90) if not heads or top else put(heads[p % len(heads)], shown)
            lines += ([("", False)] if gap_foot else []) + [(noisy(line), True)]
        if credit and r.random() < 0.6:
            lines.append((noisy(f"{author}: {title}, a digital copy"), True))
        if r.random() < 0.6:
            lines.append(("", False))
    return [t for t, _ in lines], [f for _, f in lines], title if r.random() < 0.85 else "", author if r.random() < 0.85 else ""


def furniture_tree(words: list[str], by: dict, pages: int = 450, seed: int = 3) -> Tree:
    """Trained on pages set from the clean words, heads and feet misread as the words are."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages if words else 0):
        lines, junk, title, author = _pages(r, words, by)
        filled, x = page_features(lines, title, author)
        xs.append(x)
        ys.append(np.array([junk[i] for i in filled]))
    if not xs:
        xs, ys = [np.zeros((2, len(NAMES)), np.float32)], [np.zeros(2, bool)]
    return Tree().fit(np.concatenate(xs), np.concatenate(ys), 8, 8)


# The whole


_LETTER = re.compile(r"[^\W\d_]")


class Page:
    """A scan's lines told apart: furniture, words of body lines, words divided at line ends."""

    def __init__(self, text: str, title: str | None, author: str | None, tree: Tree):
        self.lines = text.split("\n")
        filled, x = page_features(self.lines, title, author)
        junk = tree.predict(x) if filled else np.zeros(0, bool)
        self.furniture = [i for i, j in zip(filled, junk) if j]
        body = [i for i, j in zip(filled, junk) if not j]
        self.tokens = {i: self.lines[i].replace("\f", " ").split() for i in body}
        body = [i for i in body if self.tokens[i]]
        names = {w.lower() for x in (title, author) if x for w in x.split()}
        #: the word as read -> lines; (line, next line or -1, first part, mark, rest)
        self.words: dict[str, list[int]] = {}
        self.ends: list[tuple[int, int, str, str, str]] = []
        done: set[int] = set()
        for n, i in enumerate(body):
            row = self.tokens[i]
            for k, tok in enumerate(row):
                if k == 0 and i in done:
                    continue
                if k == len(row) - 1 and tok[-1] in MARKS and len(tok) > 1:
                    a = tok.lstrip(LEAD)[:-1].lower()
                    if not any(c.isalpha() for c in a):
                        continue
                    after = body[n + 1] if n + 1 < len(body) else -1
                    b = self.tokens[after][0].lstrip(LEAD).lower() if after >= 0 else ""
                    if after >= 0:
                        done.add(after)
                    self.ends.append((i, after, a, tok[-1], b))
                    continue
                full = tok.lstrip(LEAD).lower()
                low = full.rstrip(TRAIL)
                if (low.isalpha() or _LETTER.search(low)) and low not in names:
                    at = self.words.setdefault(full, [])
                    if not at or at[-1] != i:
                        at.append(i)


def _reader(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, title, author in zip(*(c.to_pylist() for c in b.columns)):
                p = Page(text, title, author, tree)
                if p.furniture:
                    out.append((doc, 0, None, None, None, p.furniture))
                out += [(doc, 1, w.rstrip(TRAIL), w, None, at) for w, at in p.words.items()]
                out += [(doc, 2, a, rest, mark, [i, nxt]) for i, nxt, a, mark, rest in p.ends]
            cols = list(zip(*out)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["doc_id", "kind", "a", "b", "mark", "lines"])

    return run


def words_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """The distinct words of clean texts, as ``w``."""
    tok = F.explode_outer(F.split(F.lower(F.col(text)), r"\s+"))
    word = F.rtrim(F.ltrim("w", F.lit(LEAD)), F.lit(TRAIL))
    return texts.filter(F.col(text).isNotNull()).select(tok.alias("w")).select(word.alias("w")).filter(F.col("w").rlike(_WORD)).distinct()


def trained(scans: DataFrame, clean: DataFrame, keys: list[str], sample: int = TRAIN_TEXTS) -> tuple[tuple[dict, dict, Tree | None], Tree]:
    """((outputs, weights, judge) of the editor, tree of the furniture), learnt from ``sample`` documents that have clean texts."""
    mine = clean.filter(F.col("text").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = clean.join(F.broadcast(mine), "doc_id").filter("text is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(*keys, "text"))).alias("parts"))
    texts = texts.select("doc_id", F.expr("array_join(transform(parts, p -> p.text), '\\n')").alias("clean"))
    seen = scans.filter("doc_id is not null and raw_text != ''").select("doc_id", "raw_text").join(F.broadcast(mine), "doc_id").groupBy("doc_id").agg(F.min("raw_text").alias("scan"))
    rows = texts.join(seen, "doc_id", "left").select("clean", "scan").orderBy(F.xxhash64("clean"), "clean").collect()
    examples, by, words = examples_of([(r.scan, r.clean) for r in rows if r.scan])
    clean_words = [w for r in rows for t in r.clean.split() for w in [core(t).lower()] if re.fullmatch(r"[^\W\d_](?:[^\W\d_'’-]|['’-](?=\w))*", w)]
    words = words or sorted(set(clean_words))
    r = random.Random(3)
    pool = sorted({*words, *clean_words})
    usual = {c: [(x, 1) for x in _LETTERS] for c in _LETTERS} if not by else by
    picked = r.choices(pool, k=TRAIN_WORDS) if pool else []
    synthetic = [(*noised(w, usual, r), []) for w in picked]
    real = examples
    examples = real * max(1, TRAIN_WORDS // (2 * max(1, len(real)))) + synthetic
    examples = [e for e in examples if e[0]]
    r.shuffle(examples)
    editor = Editor(pool).train(examples[: 2 * TRAIN_WORDS], real).judged(pool, usual)
    return (editor.by, editor.weights, editor.judge), furniture_tree(clean_words[:20_000], by)


_REPAIRS = "kind int, a string, b string, mark string, score double, divided boolean, edit_a boolean, edit_b boolean, new string"


def _decoder(model: tuple):
    def run(words: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries):
            editor = Editor(words["w"], *model)
            for q in queries.itertuples():
                if q.kind == 1:
                    new, gain = _word(q.a, q.b, editor)
                    if new != q.a:
                        out.append((1, q.a, q.b, q.mark, gain, False, True, False, new))
                else:
                    out.append((2, q.a, q.b, q.mark, *_end(q.a, q.b, q.mark, bool(q.ka), bool(q.kb), editor)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _REPAIRS.split(", ")])

    return run


def _word(low: str, full: str, editor: Editor) -> tuple[str, float]:
    """(the word repaired, gain); a misread character may look like punctuation at its end."""
    for cut in range(len(low), len(full) + 1):
        if cut == len(low) or full[cut - 1] in "!|;:(":
            new, edits, gain = editor.repair(full[:cut])
            if edits:
                return new, gain
            if full[:cut] in editor.lexicon:
                return low, 0.0
    if "-" in low:
        parts = [editor.repair(p) for p in low.split("-")]
        if any(e for _, e, _ in parts) and all(p in editor.lexicon for p, _, _ in parts):
            return "-".join(p for p, _, _ in parts), min(g for _, e, g in parts if e)
    plain = unicodedata.normalize("NFKC", low)
    if plain != low and plain.isascii():
        return plain, 0.0  # joined letter forms
    return low, 0.0


def _end(a: str, full: str, mark: str, ka: bool, kb: bool, editor: Editor) -> tuple[float, bool, bool, bool, str]:
    """(score, divided, edits in the first part, edits in the rest, whole word)."""
    marks = marks_of(mark, ka, kb, "-" in a)
    b = full.rstrip(TRAIL)
    if not b:
        own = ka and a + "-" in editor.kids
        return float(own), not own, False, False, a
    score, cut, whole, edits = editor.joined(a, b, marks)
    return score, cut == "", any(e < len(a) for e in edits), any(e > len(a) for e in edits), whole


def decoded(queries: DataFrame, lexicon: DataFrame, model: tuple) -> DataFrame:
    """The best reading of every query (kind, a, b, mark, ka, kb) over all blocks of the lexicon."""
    spark = queries.sparkSession
    blocks = max(1, -(-lexicon.count() // LEXICON_BLOCK))
    salts = max(spark.sparkContext.defaultParallelism, -(-queries.count() // QUERY_BLOCK))
    q = queries.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(salts).cast("bigint"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    w = lexicon.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks).cast("bigint"))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    out = w.groupBy("block", "salt").cogroup(q.groupBy("block", "salt")).applyInPandas(_decoder(model), _REPAIRS)
    best = F.max_by(F.struct("divided", "edit_a", "edit_b", "new"), F.struct("score", "new")).alias("r")
    return out.groupBy("kind", "a", "b", "mark").agg(best).select("kind", "a", "b", "mark", "r.*")


def read_pages(scans: DataFrame, clean: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, Tree]:
    """(what stands on the pages: doc_id, kind, a, b, mark, lines; the readings of the words that aren't known; the furniture's tree)."""
    model, tree = trained(scans, clean, keys)
    rows = scans.filter("doc_id is not null and raw_text != ''").select("doc_id", "raw_text", "title", "author")
    seen = staged(rows.mapInArrow(_reader(tree), "doc_id string, kind int, a string, b string, mark string, lines array<int>"), "scan-words")
    fixed = scans.sparkSession.createDataFrame([(w,) for w in STRUCTURE], "w string")
    lexicon = staged(words_of(clean).union(fixed).distinct(), "lexicon")
    open_ = seen.filter("kind = 1").join(lexicon, F.col("a") == F.col("w"), "left_anti")
    ends = seen.filter("kind = 2").select("kind", "a", "b", "mark").distinct()
    known = lexicon.select(F.col("w").alias("__w"), F.lit(True).alias("__k"))
    tail = F.rtrim("b", F.lit(TRAIL))
    ends = ends.join(known.withColumnRenamed("__k", "ka"), F.col("a") == F.col("__w"), "left").drop("__w").join(known.withColumnRenamed("__k", "kb"), tail == F.col("__w"), "left").drop("__w")
    no = F.lit(False)
    queries = open_.select("kind", "a", "b", F.lit("").alias("mark"), no.alias("ka"), no.alias("kb")).distinct().unionByName(ends.withColumn("ka", F.coalesce("ka", no)).withColumn("kb", F.coalesce("kb", no)))
    repairs = staged(decoded(staged(queries, "unknown-words"), lexicon, model), "readings")
    return seen, repairs, tree


def found_defects(scans: DataFrame, clean: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, line_no, defect) over the whole texts."""
    seen, repairs, _ = read_pages(scans, clean, keys)
    row = lambda df, line, defect: df.select("doc_id", line.cast("int").alias("line_no"), F.lit(defect).alias("defect"))
    junk = row(seen.filter("kind = 0").select("doc_id", F.explode("lines").alias("n")), F.col("n"), "furniture")
    words = seen.filter("kind = 1").join(repairs.filter("kind = 1").select("a", "b"), ["a", "b"], "left_semi").select("doc_id", F.explode("lines").alias("n"))
    ends = seen.filter("kind = 2").join(repairs.filter("kind = 2").drop("kind"), ["a", "b", "mark"])
    first, after = F.col("lines")[0], F.col("lines")[1]
    return (
        junk.union(row(words, F.col("n"), "misread")).union(row(ends.filter("divided"), first, "hyphen")).union(row(ends.filter("edit_a"), first, "misread"))
        .union(row(ends.filter("edit_b and lines[1] >= 0"), after, "misread")).distinct()
    )


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def paragraphs(lines: list[str | None]) -> str:
    """Repaired lines run together; blank lines and indents part paragraphs."""
    out: list[str] = []
    cur: list[str] = []
    for x in lines:
        if x is None:
            continue
        if not x:
            # a page break inside a sentence is no paragraph
            if cur and cur[-1][-1:] in ".?!”:\"":
                out.append(" ".join(cur))
                cur = []
            continue
        cur.append(x)
    if cur:
        out.append(" ".join(cur))
    return "\n\n".join(out)


def rebuilt(page: Page, repairs: dict[tuple[str, str, str], str]) -> str:
    """The page's text with the readings put in: (first part or word, rest or word as read, mark) -> whole word."""
    fixed = {i: list(t) for i, t in page.tokens.items()}
    for i, nxt, a, mark, b in page.ends:
        whole = repairs.get((a, b, mark))
        if whole is None or nxt < 0:
            continue
        tok, rest = page.tokens[i][-1], page.tokens[nxt][0]
        own = tok.lstrip(LEAD)
        fixed[i][-1] = tok[: len(tok) - len(own)] + _cased(whole, own) + rest[len(rest.rstrip(TRAIL)) :]
        fixed[nxt][0] = ""
    for full, at in page.words.items():
        new = repairs.get((full.rstrip(TRAIL), full, ""))
        if new is None:
            continue
        for i in at:
            for k, tok in enumerate(page.tokens[i]):
                own = tok.lstrip(LEAD)
                if own.lower() == full and fixed[i][k] == tok:
                    fixed[i][k] = tok[: len(tok) - len(own)] + _cased(new, own) + own[len(own.rstrip(TRAIL)) :]
    drop = set(page.furniture)
    return paragraphs([None if i in drop else " ".join(x for x in fixed.get(i, []) if x) for i in range(len(page.lines))])


def _rebuilder(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for doc, text, title, author, fixes in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(doc)
                texts.append(rebuilt(Page(text, title, author, tree), {(f["a"], f["b"], f["mark"]): f["new"] for f in fixes or []}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def repaired(scans: DataFrame, clean: DataFrame, keys: list[str]) -> DataFrame:
    """(doc_id, text): whole, readable paragraphs; of rows delivered twice with other texts the least text counts."""
    once = scans.filter("doc_id is not null and raw_text != ''").groupBy("doc_id").agg(F.min(F.struct("raw_text", "title", "author")).alias("r")).select("doc_id", "r.*")
    seen, repairs, tree = read_pages(once, clean, keys)
    mark = F.coalesce("mark", F.lit(""))
    uses = seen.filter("kind > 0").withColumn("mark", mark).join(repairs, ["kind", "a", "b", "mark"]).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b", "mark", "new")).alias("fixes"))
    return once.join(uses, "doc_id", "left").select("doc_id", "raw_text", "title", "author", "fixes").mapInArrow(_rebuilder(tree), "doc_id string, text string")
