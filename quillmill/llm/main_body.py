r"""Problem 3: the main body of web pages, line by line.

A page is a sequence of flat text blocks, one per line. A block has its word count and link density
(the share of its characters in anchors, addresses and runs of menu items), the same of its neighbours,
its place on the page and marks of its shape (sentence ends, capitals, figures, separators). A decision
tree trained on a small labelled table (``LABELLED``, assembled into pages by a fixed seed) calls it body
or furniture. No wording is a feature: what tells a standing line is that it, or its beginning or end,
recurs on many pages. Five bits say so: the whole line does on its own source's pages, or on those of many
sources; its first piece, its last piece, its lead before a colon do on either. The tree is asked for every
setting of the bits where the page is read, and only blocks whose class depends on them are counted;
everything else is settled there and then.

Defined results: null and empty texts have no lines; texts that are no prose (the tree never sees
them) have no furniture; blank lines are neither; copies of one text count once towards repetition;
an id delivered twice counts once; pages of one line, and very long pages, are treated alike; a null
source is a source of its own for repetition across sources and none for repetition within one.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common_words import WORDS
from quillmill.llm.quality import MAX_BULLETS, MAX_SHORT, MAX_SYMBOLS, MIN_ALPHABETIC, MIN_COMMON, MIN_ENDED, MIN_STOPS, SHORT_LINE, WORD_LENGTH
from quillmill.runtime import ship, staged

ship(__name__)
ship("quillmill.llm.common_words")

#: A piece recurs within a source from so many distinct texts and this share of them on,
#: and across sources from so many sources and this share of them on.
MIN_REPEATS, MIN_SHARE = 3, 0.08
MIN_SOURCES, MIN_SOURCE_SHARE = 5, 0.005
#: Sites of the training set (one to twelve pages each) that are assembled from the labelled lines.
TRAIN_SITES, DEPTH, LEAF = 700, 14, 12

TAGS = r"<[^<>\n]+>"
LINKED = r"(?i)<a\b[^>]*>.*?</a>|https?://\S+|www\.\S+|\S+@\S+\.\S+"
END = "[.!?…:][\"'”’»)\\]]*$"
SENTENCE = "[.!?…][\"”’»)]*(?:\\s|$)"
MARK = r"^(?:[-–•*·☐›>]|\[[ x]?\]|\(?\d{1,3}[.)])\s+\S"
SEPARATORS = r"[|·›»/•>→]|\s{2,}|\s[–—-]\s"
COMMON = r"\b(?:" + "|".join(sorted({w for v in WORDS.values() for w in v}, key=lambda w: (-len(w), w))) + r")\b"
#: What parts a line into pieces.
PIECE = r"[.!?…:;,|·›»→←—–(){}\[\]\"“”]"

NAMES = (
    "words links p_words p_links n_words n_links p_ends n_ends pp_words pp_links nn_words nn_links pp_ends nn_ends ends sents caps digits seps symbols mark colon head_digit quoted lower upper title common "
    "top end place above below tail since until whole_here whole_abroad first last lead"
).split()
BITS, PIECES = ("whole_here", "whole_abroad", "first", "last", "lead"), ("whole", "first", "last", "lead")
_BIT0 = len(NAMES) - len(BITS)


class Blocks:
    """The non-blank lines of some texts: document, line number, raw line, bare text."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, "\n")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = lists.flatten()
        doc = np.repeat(np.arange(len(texts)), size)
        no = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        open_ = pc.replace_substring_regex(raw, TAGS, " ")
        bare = pc.utf8_trim_whitespace(pc.replace_substring_regex(open_, r"[\s\p{Z}]+", " "))
        keep = pc.not_equal(bare, "")
        self.doc, self.no = doc[np.asarray(keep)], no[np.asarray(keep)]
        self.raw, self.open, self.bare = raw.filter(keep), open_.filter(keep), bare.filter(keep)
        self.low = pc.utf8_lower(self.bare)

    def __len__(self) -> int:
        return len(self.doc)

    def pieces(self) -> np.ndarray:
        """Hashes of the whole line, its first piece, its last piece and its lead (0 without one); figures are alike."""
        text = pc.replace_substring_regex(self.low, r"[\p{L}\p{N}]*\p{N}[\p{L}\p{N}]*", "0")
        text = pc.replace_substring_regex(pc.replace_substring_regex(text, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")
        first = pc.utf8_rtrim_whitespace(pc.replace_substring_regex(text, rf"(?s){PIECE}.*$", ""))
        last = pc.utf8_ltrim_whitespace(pc.replace_substring_regex(text, rf"(?s)^.*{PIECE}", ""))
        lead = pc.if_else(pc.match_substring_regex(text, r"^(?:[^\s:]+ ){0,5}[^\s:]+:"), pc.replace_substring_regex(text, r"(?s):.*$", ""), "")
        out = np.empty((len(self), 4), np.int64)
        for k, p in enumerate((text, first, last, lead)):
            # the place of a piece is part of its key
            h = pd.util.hash_array(np.asarray(p, dtype=object), categorize=True) if len(p) else np.zeros(0, np.uint64)
            h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)
            out[:, k] = np.where(np.asarray(pc.equal(p, "")), 0, h)
        return out


def _shift(v: np.ndarray, doc: np.ndarray, by: int, none: float) -> np.ndarray:
    """The value ``by`` blocks further on the same page."""
    out = np.full(len(v), none, np.float32)
    if abs(by) < len(v):
        a, b = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
        out[a] = np.where(doc[a] == doc[b], v[b], none)
    return out


def features(b: Blocks, titles: list[str | None]) -> np.ndarray:
    """One row of ``NAMES`` per block; the bits are left at 0."""
    n = len(b)
    x = np.zeros((n, len(NAMES)), np.float32)
    if not n:
        return x
    col = {name: i for i, name in enumerate(NAMES)}
    num = lambda a: np.asarray(a).astype(np.float32)
    put = lambda name, v: x.__setitem__((slice(None), col[name]), v)
    doc = b.doc
    length = np.maximum(num(pc.utf8_length(b.bare)), 1)
    words = num(pc.count_substring(b.bare, " ")) + 1
    ends = num(pc.match_substring_regex(b.bare, END))
    sents = num(pc.count_substring_regex(b.bare, SENTENCE))
    mark = num(pc.match_substring_regex(b.bare, MARK))
    seps = num(pc.count_substring_regex(pc.utf8_trim_whitespace(b.open), SEPARATORS))
    rest = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.replace_substring_regex(b.raw, LINKED, ""), TAGS, ""))
    anchor = np.clip(1 - num(pc.utf8_length(rest)) / length, 0, 1) * num(pc.match_substring_regex(b.raw, LINKED))
    inline = num(pc.match_substring_regex(b.raw, r"^\s*<(?:span|a|button|nav)\b"))  # such an element alone on its line is no paragraph
    lone = (words <= 2) & (ends == 0) & (mark == 0)
    run = lone & ((_shift(lone, doc, 1, 0) > 0) | (_shift(lone, doc, -1, 0) > 0))
    menu = (seps >= 1) & (words <= 4 * (seps + 1)) & (ends == 0) & (mark == 0)
    links = np.maximum(np.maximum(anchor, inline), (run | menu).astype(np.float32))
    long_ = (words >= 15) & (sents >= 1)
    body = (ends > 0) & (words >= 4)
    for name, v in {"words": words, "links": links, "ends": ends, "sents": sents, "seps": seps, "mark": mark}.items():
        put(name, v)
    for name, v, none in (("words", words, 0), ("links", links, -1), ("ends", ends, -1)):
        for prefix, by in (("p_", -1), ("n_", 1), ("pp_", -2), ("nn_", 2)):
            put(prefix + name, _shift(v, doc, by, none))
    put("caps", num(pc.count_substring_regex(b.bare, r"(?:^|[\s(“\"‘'])\p{Lu}")) / words)
    put("digits", num(pc.count_substring_regex(b.bare, r"\p{N}")) / length)
    put("symbols", num(pc.count_substring_regex(b.bare, r"[^\p{L}\p{N}\s.,;:!?'\"“”‘’()…-]")) / length)
    colon = num(pc.find_substring(b.bare, ":"))
    put("colon", np.where(colon < 0, 1e6, colon))
    put("head_digit", num(pc.match_substring_regex(b.bare, r"^\S*\p{L}\S*\p{N}|^(?:\S+ ){1,2}\S*\p{L}\p{N}+:")))
    put("quoted", num(pc.match_substring_regex(b.bare, "^[“\"«„]")))
    put("lower", num(pc.match_substring_regex(b.bare, r"^\p{Ll}")))
    put("upper", num(pc.utf8_is_upper(b.bare)))
    bare_title = [re.sub(r"\W+", " ", t).strip().lower() if t else "" for t in titles]
    same = pc.equal(pc.utf8_trim_whitespace(pc.replace_substring_regex(b.low, r"[^\p{L}\p{N}_]+", " ")), pa.array(bare_title).take(pa.array(doc)))
    put("title", num(same))
    put("common", num(pc.count_substring_regex(b.low, COMMON)) / words)
    # places, per page
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, n])
    start, stop = np.repeat(first, size), np.repeat(first + size, size)
    at = np.arange(n)
    put("top", at - start)
    put("end", stop - 1 - at)
    put("place", (at - start) / np.maximum(stop - start - 1, 1))

    def before(flag: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(flag)]
        return c[at] - c[start]

    def after(flag: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(flag)]
        return c[stop] - c[at + 1]

    put("above", before(long_))
    put("below", after(long_))
    put("tail", after(body))
    last_long = np.maximum.accumulate(np.where(long_, at, -1))
    last_long = np.r_[-1, last_long[:-1]]
    put("since", np.where(last_long >= start, at - last_long, 1e3))
    next_long = np.minimum.accumulate(np.where(long_, at, n)[::-1])[::-1]
    next_long = np.r_[next_long[1:], n]
    put("until", np.where(next_long < stop, next_long - at, 1e3))
    return x


class Tree:
    """A CART with Gini splits, held in arrays."""

    def __init__(self) -> None:
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.kids: list[tuple[int, int]] = []
        self.share: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> Tree:
        self._grow(x, y.astype(np.float64), depth, leaf)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> int:
        at = len(self.feature)
        self.feature.append(-1)
        self.cut.append(0.0)
        self.kids.append((-1, -1))
        self.share.append(float(y.mean()))
        if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        total = y.sum()
        n = len(y)
        base = total * (n - total) / n
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            i = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (i >= leaf) & (n - i >= leaf)
            if not ok.any():
                continue
            a = s[:-1]
            gain = base - a * (i - a) / i - (total - a) * ((n - i) - (total - a)) / (n - i)
            gain[~ok] = -1
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), f, float((v[j] + v[j + 1]) / 2))
        if best[1] < 0:
            return at
        self.feature[at], self.cut[at] = best[1], best[2]
        left = x[:, best[1]] <= best[2]
        self.kids[at] = (self._grow(x[left], y[left], depth - 1, leaf), self._grow(x[~left], y[~left], depth - 1, leaf))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """True for furniture."""
        feature, cut, kids, share = np.array(self.feature), np.array(self.cut, np.float32), np.array(self.kids), np.array(self.share)
        node = np.zeros(len(x), np.int64)
        live = np.flatnonzero(feature[node] >= 0)
        while len(live):
            f = feature[node[live]]
            right = x[live, f] > cut[node[live]]
            node[live] = kids[node[live], right.astype(int)]
            live = live[feature[node[live]] >= 0]
        return share[node] > 0.5

    def masks(self, x: np.ndarray) -> np.ndarray:
        """The class under every setting of the bits, one bit a setting; recurring pieces only ever add furniture."""
        x = x.copy()
        out = np.zeros(len(x), np.uint32)
        for setting in range(1 << len(BITS)):
            x[:, _BIT0:] = [setting >> k & 1 for k in range(len(BITS))]
            out |= self.predict(x).astype(np.uint32) << np.uint32(setting)
        return np.where(out & 1, np.uint32(0xFFFFFFFF), out).view(np.int32)


#: The labelled table: lines as web pages commonly have them, written and labelled by hand. Kind (F furniture,
#: B body, M a motto, furniture that only its return on the site's pages betrays), place on the page (T top,
#: I inside, E end, A any), line. {S} stands for a site's name, {H} its host, {N} a person, {D} a date,
#: {I} a number, {T} the title of another piece, {W} a word, {U} a commenter, {P} a sentence.
LABELLED = """
F|T|Home
F|T|Blog
F|T|Categories
F|T|Sign in
F|T|Gallery
F|T|About us
F|T|About
F|T|About me
F|T|How it works
F|T|Start now
F|T|Services
F|T|Projects
F|T|Support
F|T|Careers
F|T|Forum
F|T|Resources
F|T|My basket
F|T|Home | Services | Gallery | Support
F|T|Projects / Forum / Careers / Blog / Resources
F|T|Blog  Gallery  Forum  Support
F|T|Latest · Popular · Archive · Login
F|T|Home › Guides › {T}
F|T|Home / {W} / {T}
F|T|Start > {W}
F|T|Jump to main content
F|T|Open the menu
F|T|Type to search…
F|T|This website uses cookies to give you the best experience. I agree | Learn more
F|T|Cookie consent: we and {I} vendors store information on your device.
F|T|We value your privacy. Customise / Reject all / Accept
F|T|Diese Website benutzt Cookies. Mehr erfahren – Einverstanden
F|T|Este sitio web utiliza cookies para mejorar su experiencia. Aceptar / Rechazar
F|T|Ce site utilise des cookies pour vous offrir le meilleur service. J'accepte
F|T|{S} asks for your permission to use your personal data.
F|T|by {N}
F|T|Text: {N} | {D}
F|T|{D}, {N}
F|T|{D} – {I} minutes
F|T|{N} · {D} · {I} minute read
F|T|Estimated reading time: {I} minutes
F|T|Published on {D} under {W}
F|T|Updated {D} by {N}
F|T|An article by {N} for {S}
F|T|From the editors of {S} on {D}
F|T|{S} — stories for curious people
F|T|{S}: the weekly reader
F|A|Share on Facebook | Tweet | Pin it
F|A|Share: Mail · WhatsApp · Print
F|A|Bookmark this post
F|A|{I} shares, {I} comments
F|A|Did you enjoy this? Pass it on to a colleague.
F|A|Support our work by giving this post a like
F|A|Subscribe to the {S} newsletter and get new posts by mail. Your email
F|A|Get our free guide. {P} Download now
F|A|Over {I} people read {S} every week. Sign up here
F|A|Become a member of {S} today
F|A|Our monthly letter reaches {I} inboxes. {P} Subscribe today.
F|A|You can cancel at any time. We respect your inbox
F|A|New in the shop: {T} for {I} euros
F|A|{P} Order the planner for {I} dollars at {H}.
F|A|Save {I} percent with the code {W} at checkout.
F|A|This post is supported by {W} – try it free for {I} days.
F|A|Ad
F|A|Continue reading below the ad
F|A|Promotion: {T}
F|A|Disclosure: we may earn a fee when you buy through our links.
F|A|See also: {T}
F|A|More like this: {T}
F|A|More from {S}: {T}
F|A|Don't miss: {P} {P}
F|A|This week on the {S} show: {P} {P}
F|A|Hear the conversation with {N} on the {S} podcast
F|A|Photo: {N}
F|A|Picture credits: {S} archive
F|A|Figure by {N}, {S}
F|A|„{P}“ — {N}, reader
F|A|“{P}” — a member of our community
F|A|★ ★ ★ ★ ★ {I} reviews
F|E|Up next: {T} »
F|E|« Older: {T}
F|E|Newer: {T} »
F|E|Most read: {T} | {T}
F|E|Top stories
F|E|Editor's picks
F|E|Topics: {W}, {W}, {W}
F|E|Labels: {W} | {W}
F|E|In category {W}
F|E|{I} responses
F|E|{U}, {D}: {P}
F|E|{U} wrote: {P} {P}
F|E|{U} ({D}): {P}
F|E|{U} replied: {P}
F|E|Answer by {U}: {P}
F|E|Comment by {U}: {P} {P}
F|E|Write a comment. Your address stays private. Fields with a star are needed *
F|E|You must be logged in to comment
F|E|{N} is a writer for {S} and lives by the sea with a dog.
F|E|About {N}: coach, speaker and host of the {S} podcast.
F|E|{N} writes a letter on {W} every Friday.
F|E|About us: {S} is a project by volunteers. {P}
F|E|Follow {S} on Instagram, YouTube and Facebook
F|E|© {I} {S}
F|E|© {I} {N}, all rights reserved
F|E|Copyright © {I} {H}. Reprints only with consent
F|E|Opinions in this post belong to {N} and nobody else.
F|E|This page gives general information and can't replace a visit to a doctor.
F|E|{S} owns the contents of this site; you may not copy them, in whole or in part, without our consent.
F|E|We changed some names to protect people; nothing written on {H} is legal or financial advice.
F|E|Typed up from a recording by {S}; please forgive mistakes.
F|E|Legal notice | Data protection | Contact
F|E|Imprint · Privacy · Terms · Accessibility
F|E|Advertise with us | Jobs | Press
F|E|Write to us: {W}@{H}
F|E|Scroll to top
F|E|Found a mistake? Let us know
F|E|1 2 3 4 … {I} Next
F|E|Page {I} of {I}
F|E|Made with care in a small town
F|E|Retrieved from {H}, {D}
F|E|This mail was sent to you by {S}. Unsubscribe
M|A|{P}
M|A|{F}
M|A|{F}
M|A|{P}
B|A|{T}
B|A|{T}
B|A|What we know so far
B|A|In a nutshell
B|A|Three small steps
B|A|Main points
B|A|Takeaway
B|A|What helps
B|A|The evidence
B|A|Where to begin
B|A|Before you start
B|A|A last word
B|A|Why {W} matters
B|A|{T}
B|A|{P}
B|A|{P} {P}
B|A|{P} {P} {P}
B|A|{P} {P} {P} {P}
B|A|{P} {P} {P} {P} {P} {P}
B|A|{P} {P} {P}
B|A|{P} {P}
B|A|“{P}” said {N}. {P}
B|A|Look for the {W} first.
B|A|Then came the {W}.
B|A|Sign nothing in anger about {W}.
B|A|Crumbs on the {W}, silence in the {W}.
B|A|Alike, yet never the same: {W} and {W}.
B|A|The {W} of {W}
B|A|So much for {W}.
B|A|In short: {P}
B|A|One more thing - {P}
B|A|Note: {P}
B|A|Side note - {P}
B|A|PS: {P}
B|A|“{P},” they said.
B|A|“Never.”
B|A|“Perhaps,” she said.
B|A|No {W}. No {W}.
B|A|Think about the {W}, then the {W}.
B|A|Years of {W} went by for {N}.
B|A|- {P}
B|A|• {P}
B|A|* {P}
B|A|{L}. {P}
B|A|{L}. {T}
B|A|[ ] {T}
B|A|☐ {T}
B|A|> {P}
B|A|{C}
B|A|{C}
B|A|{C}
B|A|{P} ({H}) {P}
B|A|{P} <a href='/{L}'>{W}</a> {P}
B|A|{P} (t = 1.{L}, n = {I}). {P}
B|A|{G}
B|A|{G}
"""

_ADJ = "calm quiet patient hidden stubborn familiar gentle restless early slow bitter useful private tired brave".split()
_NOUN = "morning friend habit body partner silence choice plan memory reader letter garden teacher pride boundary sibling".split()
_VERB = "follows hides softens repeats carries invites avoids mirrors forgives names delays rewards tests shapes questions".split()
_TAIL = ["because of an old promise", "until the evening ends", "even if nobody asks", "instead of the plan", "once the noise fades", "at the edge of the day", "while you wait", "as soon as she rests"]
_OPEN = ["After all, ", "At first, ", "Sometimes, ", "Still, ", "At home ", "Later on, ", "Every so often ", "As a rule, ", "In theory, ", "These days ", "Oddly, ", "Years ago ", "For most of us ", "Then again, ", "Now and then, ", "To begin with, ", "No wonder ", "Next, "]
_DET = "the a one her our your that this every another".split()
_GERMAN = ["Die leise Angst ordnet den Tag, und niemand fragt danach.", "Das alte Muster bleibt, solange wir schweigen.", "La rutina sencilla cambia el miedo, aunque duela al principio.", "Le petit rituel protège la nuit, comme dans toute relation."]
_SYL = "pal tor min vel sha ken dri fen lud bra oru".split()


def _filled(template: str, r: random.Random, site: dict[str, str]) -> str:
    def noun() -> str:
        return f"{r.choice(_DET)} {r.choice(_ADJ)} {r.choice(_NOUN)}"

    def clause() -> str:
        return f"{noun()} {r.choice(['often ', 'rarely ', 'slowly ', 'never ', ''])}{r.choice(_VERB)} {noun()}"

    def name(k: int = 3) -> str:
        return "".join(r.choice(_SYL) for _ in range(k))

    def value(m: re.Match) -> str:
        k = m[1]
        if k in site:
            return site[k]
        if k == "I":
            return str(r.choice([r.randrange(1, 30), r.randrange(100, 9999), 2019 + r.randrange(6)]))
        if k == "L":
            return str(r.randrange(1, 9))
        if k == "D":
            return r.choice([f"{r.randrange(1, 28)}.{r.randrange(1, 12)}.20{r.randrange(15, 25)}", f"20{r.randrange(15, 25)}-0{r.randrange(1, 9)}-1{r.randrange(9)}", f"{r.choice(['March', 'June', 'May'])} {r.randrange(1, 28)}, 20{r.randrange(15, 25)}"])
        if k == "W":
            return r.choice(_NOUN) if r.random() < 0.15 else name(r.choice([2, 3]))
        if k == "U":
            return r.choice([f"{name()}{r.randrange(99)}", f"{name()}{r.randrange(99)}", name(2).capitalize()])
        if k == "T":
            first = r.choice(["", "", "", "How to keep ", "The side of you that ", "Anyone who often "])
            return first + clause() if first else clause().capitalize()
        if k == "P":
            text = f"{clause()} {r.choice(_TAIL)}{r.choice(['.', '.', '?'])}"
            return r.choice(_OPEN) + text if r.random() < 0.4 else text.capitalize()
        if k == "F":
            return f"{r.choice(['Slowly ', 'Rarely ', 'Never ', ''])}{r.choice(_VERB)} {noun()}, {r.choice(_TAIL)}".capitalize()
        if k == "C":
            # a line of running text that goes on in the next, without its end
            return clause() + " and " + clause()
        return r.choice(_GERMAN) + " " + r.choice(_GERMAN)

    return re.sub(r"\{(\w)\}", value, template)


def labelled(half: int | None = None) -> dict[tuple[str, str], list[str]]:
    """Lines by kind and place; ``half`` 0 or 1 gives every second furniture line, so that the other half is unseen."""
    out: dict[tuple[str, str], list[str]] = {}
    for i, row in enumerate(LABELLED.strip().split("\n")):
        kind, place, text = row.split("|", 2)
        if kind != "F" or half is None or i % 2 == half:
            out.setdefault((kind, place), []).append(text)
    return out


def _page(r: random.Random, site: dict[str, str], own: dict[str, list[str]], mottos: list[str], kinds: dict) -> tuple[list[tuple[str, bool]], str]:
    """(lines and whether they are furniture, title)."""
    fill = lambda t: _filled(t, r, site)
    page: list[tuple[str, bool]] = []
    if r.random() < 0.2:
        # a page of text with hardly any furniture
        own = {**own, "menu": [], "T": [], "I": own["I"][:1], "E": []}
    if r.random() < 0.5 and own["menu"]:
        page += [(t, True) for t in own["menu"]]
    page += [(fill(t), True) for t in r.sample(own["T"], r.randrange(0, min(7, len(own["T"]) + 1)))]
    title = fill("{T}")
    if r.random() < 0.6:
        page.append((title, False))
    heavy = r.random() < 0.75
    if r.random() < 0.25:
        # a list in the text
        sign, t = r.choice(["• ", "- ", "* ", "☐ ", "> "]), r.choice(["{P}", "{P}", "{T}"])
        page += [(fill(r.choice(["{P} {P}", "{P}"])), False)] + [(fill(sign + t), False) for _ in range(r.randrange(2, 9))]
    if r.random() < 0.3:
        # running text broken into short lines
        words = fill(" ".join(["{P}"] * r.randrange(4, 16))).split()
        if r.random() < 0.5:
            # spoken text: no capitals, no marks
            words = [w.strip(".?,").lower() for w in words]
        k = r.randrange(6, 13)
        page += [(" ".join(words[i : i + k]), False) for i in range(0, len(words), k)]
    heads = [t for t in kinds["B", "A"] if len(t.split()) <= 5 and t[-1] not in ".”}:"] if r.random() < 0.3 else []
    for _ in range(r.randrange(2, 12)):
        t = r.choice(["{P} {P} {P}", "{P} {P} {P} {P}", "{P} {P}"]) if heavy and r.random() < 0.6 else r.choice(kinds["B", "A"])
        if heads and r.random() < 0.4:
            page.append((fill(r.choice([*heads, "{W} and {W}", "{T}"])), False))
            t = r.choice(["{P} {P} {P}", "{P} {P}"])
        page.append((fill(t), False))
        if r.random() < 0.2 and own["I"]:
            page.append((fill(r.choice(own["I"])), True))
        if r.random() < 0.2 and mottos:
            page.append((r.choice(mottos), True))
    tail = [fill(t) for t in r.sample(own["E"], r.randrange(0, min(12, len(own["E"]) + 1)))]
    if tail and r.random() < 0.3:
        # titles of other pieces
        where = r.randrange(len(tail) + 1)
        tail[where:where] = [fill("{T}") for _ in range(r.randrange(1, 6))]
    if len(tail) > 5 and r.random() < 0.2:
        # how another piece begins, deep in the tail
        tail.insert(r.randrange(4, len(tail)), fill("{P} {P}"))
    page += [(t, True) for t in tail]
    if r.random() < 0.1:
        page = [(t.upper() if f and r.random() < 0.5 else t, f) for t, f in page]
    if r.random() < 0.45:
        tag = lambda t, f: r.choice(["<a href='/x'>{0}</a>", "<span class='c'>{0}</span>"]).format(t) if f and r.random() < 0.5 else f"<p class='c'>{t}</p>"
        page = [(tag(t, f), f) for t, f in page]
    return page, title


def training_pages(sites: int = TRAIN_SITES, seed: int = 11, half: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of sites assembled from the labelled table; the bits are counted over them as over a corpus."""
    r = random.Random(seed)
    kinds = labelled(half)
    pick = lambda rows, k: r.sample(rows, min(k, len(rows)))
    texts, titles, sources, labels, bodies = [], [], [], [], []
    for s in range(sites):
        a, b, name = r.choice(["Slow", "Paper", "North", "Amber"]), r.choice(["Ledger", "Garden", "Notes", "Room"]), "".join(r.choice(_SYL) for _ in range(3))
        site = {"S": f"{a} {b} {name.capitalize()}", "H": f"{a.lower()}{b.lower()}-{name}.example", "N": f"{name.capitalize()} {r.choice(_SYL).capitalize()}{r.choice(_SYL)}"}
        any_ = kinds["F", "A"]
        singles = [t for t in kinds["F", "T"] if len(t.split()) <= 2]
        own = {"menu": pick(singles, r.randrange(0, 8)), "T": pick([t for t in kinds["F", "T"] if t not in singles], 12), "I": pick(any_, 10), "E": pick(kinds["F", "E"], 16) + pick(any_, 10)}
        own["T"] += pick(any_, 2)
        mottos = [_filled(r.choice(kinds["M", "A"]), r, site) for _ in range(r.choice([0, 1, 1, 2]))]
        for _ in range(r.randrange(1, 12)):
            page, title = _page(r, site, own, mottos, kinds)
            if r.random() < 0.03:
                page = [(_filled(r.choice(["{T}", "{P}", "[{W}]"]), r, site), False)]
            if bodies and r.random() < 0.04:
                # a near copy of another page's body, in this page's furniture
                other = r.choice(bodies[-6:])
                kept = [(t, f) for t, f in page if f]
                at = r.randrange(len(kept) + 1)
                page = kept[:at] + other[: r.randrange(1, len(other) + 1)] + kept[at:]
            own_body = [(t, f) for t, f in page if not f]
            if own_body:
                bodies.append(own_body)
            texts.append("\n".join(t for t, _ in page))
            titles.append(title if r.random() < 0.7 else None)
            sources.append(s)
            labels += [f for _, f in page]
    b = Blocks(pa.array(texts))
    x = features(b, titles)
    keys = b.pieces()
    source = np.array(sources)[b.doc]
    pages = np.bincount(sources)
    for k in range(len(PIECES)):
        df = pd.DataFrame({"key": keys[:, k], "source": source, "doc": b.doc}).query("key != 0").drop_duplicates()
        n = df.groupby(["source", "key"]).size()
        within = n[(n >= MIN_REPEATS) & (n >= MIN_SHARE * pages[n.index.get_level_values(0)])]
        m = df.drop_duplicates(["source", "key"]).groupby("key").size()
        wide = m[(m >= MIN_SOURCES) & (m >= MIN_SOURCE_SHARE * sites)].index
        here, abroad = pd.MultiIndex.from_arrays([source, keys[:, k]]).isin(within.index), np.isin(keys[:, k], wide)
        if k == 0:
            x[:, _BIT0], x[:, _BIT0 + 1] = here, abroad
        else:
            x[:, _BIT0 + 1 + k] = here | abroad
    return x, np.array(labels)


_TREE: list[Tree] = []


def tree() -> Tree:
    if not _TREE:
        _TREE.append(Tree().fit(*training_pages()))
    return _TREE[0]


def is_prose(b: Blocks, x: np.ndarray, pages: int) -> np.ndarray:
    """Per page: the rules of ``quality`` on the blocks at hand."""
    col = {name: i for i, name in enumerate(NAMES)}
    total = lambda v: np.bincount(b.doc, np.asarray(v, np.float64), pages)
    share = lambda v, of: np.divide(v, of, out=np.zeros(pages), where=of > 0)
    tokens = x[:, col["words"]].astype(np.float64)
    visible = np.asarray(pc.utf8_length(b.bare)) - (tokens - 1)
    common, words = total(tokens * x[:, col["common"]]), total(pc.count_substring_regex(b.low, r"[\p{L}\p{N}]+"))
    lines, seen = total(np.ones(len(b))), total(visible)
    bad = ~((share(seen, total(tokens)) >= WORD_LENGTH[0]) & (share(seen, total(tokens)) <= WORD_LENGTH[1]))
    bad |= share(total(pc.count_substring_regex(b.low, r"\p{N}*\p{L}[\p{L}\p{N}]*")), words) < MIN_ALPHABETIC
    bad |= share(total(pc.count_substring_regex(b.bare, r"#|…|\.\.\.")), total(tokens)) > MAX_SYMBOLS
    bad |= (share(total(x[:, col["mark"]]), lines) > MAX_BULLETS) | (common < MIN_STOPS - 0.5) | (share(common, words) < MIN_COMMON)
    short = np.where(np.asarray(pc.utf8_length(b.bare)) < SHORT_LINE, visible, 0)
    return ~(bad | ((share(total(x[:, col["ends"]]), lines) < MIN_ENDED) & (share(total(short), seen) > MAX_SHORT)))


def _classifier(model: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, titles, sources, copies = batch.columns
            b = Blocks(texts)
            x = features(b, titles.to_pylist())
            prose = is_prose(b, x, len(texts)) | (np.asarray(pc.utf8_length(texts)) < 100)
            masks = np.where(prose[b.doc], model.masks(x), 0).astype(np.int32)
            take = np.flatnonzero(masks)
            open_ = masks[take] & 1 == 0
            keys = np.where(open_[:, None], b.pieces()[take], 0)
            # a page's own row, line -1, counts it
            n = len(texts)
            doc = pa.array(np.concatenate([b.doc[take], np.arange(n)]))
            no = np.concatenate([b.no[take], np.full(n, -1)]).astype(np.int32)
            mask = np.concatenate([masks[take], np.zeros(n, np.int32)])
            keys = np.concatenate([keys, np.zeros((n, len(PIECES)), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [ids.take(doc), pa.array(no), sources.take(doc), copies.take(doc), pa.array(mask), *(pa.array(np.ascontiguousarray(keys[:, k])) for k in range(len(PIECES)))],
                names=["item_id", "line_no", "source", "copy", "mask", *PIECES],
            )

    return run


_LINES = "item_id string, line_no int, source bigint, copy bigint, mask int, whole bigint, first bigint, last bigint, lead bigint"


def furniture(pages: DataFrame) -> DataFrame:
    """(item_id, line_no) of every non-blank line that is no main body.

    ``pages``: item_id, text, title, source (an author's or site's key, null if unknown).
    """
    rows = pages.filter(F.col("item_id").isNotNull() & (F.col("text") != "")).select("item_id", "text", "title", F.xxhash64("source").alias("__h"), F.col("source").isNull().alias("__n"))
    rows = rows.select("item_id", "text", "title", F.when(~F.col("__n"), F.col("__h")).alias("source"), F.xxhash64("text").alias("copy"))
    lines = staged(rows.mapInArrow(_classifier(tree()), _LINES), "furniture")
    own = F.coalesce("source", F.lit(0)).alias("source")
    sure = lines.filter("mask & 1 = 1").select("item_id", "line_no")
    pieces = lines.filter("mask & 1 = 0 and line_no >= 0").select("item_id", "line_no", "mask", own, "copy", F.posexplode(F.array(*PIECES)).alias("piece", "key")).filter("key <> 0")
    # copies of a page count once; pages of no known source stand for one source
    seen = pieces.groupBy("key", "source").agg(F.countDistinct("copy").alias("n"))
    read = lines.filter("line_no < 0").groupBy(own).agg(F.countDistinct("copy").alias("pages"))
    sources = read.agg(F.count(F.lit(1)).alias("sources")).first().sources
    wide = seen.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= max(MIN_SOURCES, MIN_SOURCE_SHARE * sources)).select("key")
    abroad = seen.select("key", "source").join(wide, "key", "left_semi").withColumn("where", F.lit(2))
    here = seen.filter((F.col("n") >= MIN_REPEATS) & (F.col("source") != 0)).join(read, "source").filter(F.col("n") >= MIN_SHARE * F.col("pages")).select("key", "source", F.lit(1).alias("where"))
    again = here.union(abroad).groupBy("key", "source").agg(F.bit_or("where").alias("where"))
    bit = F.when(F.col("piece") == 0, F.col("where")).otherwise(F.expr("shiftleft(2, piece)"))
    bits = pieces.join(again, ["key", "source"]).groupBy("item_id", "line_no").agg(F.first("mask").alias("mask"), F.bit_or(bit).alias("bits"))
    return sure.unionByName(bits.filter("shiftright(mask, bits) & 1 = 1").select("item_id", "line_no")).distinct()


def main_bodies(pages: DataFrame) -> DataFrame:
    """(item_id, text, body): every page with its furniture lines taken out; blank lines stay."""
    cut = furniture(pages).groupBy("item_id").agg(F.collect_set("line_no").alias("__cut"))
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(__cut, i)), '\\n')")
    once = pages.filter("item_id is not null").dropDuplicates(["item_id"])
    return once.join(cut, "item_id", "left").select("item_id", "text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(kept).alias("body"))


def source_of_url(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*://)?([^/?#:\s]+)", 1)), r"^(?:www|m)\.", "")
    return F.when(host != "", F.concat(F.lit("h:"), host))
