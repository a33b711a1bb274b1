"""Problem 9: passages of held-out items inside a corpus.

Q-gram lemma filter. Both sides are reduced to lower-cased words joined by one blank. A run of words
with at most ``k`` of them edited keeps a stretch of its share of the words whole, so it shares at least
``length of the stretch - q + 1`` q-grams, all within a band of neighbouring diagonals. The items'
q-grams are indexed at every position; a document is probed at every ``step``-th, so at least
``probes`` hits remain. Hits are counted in bands of diagonals that overlap by half, bands that reach
the bound are kept, and their regions are verified by alignment within the band. With ``k = 0``, as
in ``p9_found``, the alignment is the extension of one diagonal.

The items are a stated query set: a hash table of their q-grams goes to the executors, at most
``MAX_ITEM_CHARS`` characters of items at a time. Larger sets are cut into blocks of that size: a block is
sent out, the corpus is scanned, its pairs are written, and the block is destroyed before the next.

Defined results: null and empty texts match nothing; every (document, item) pair comes out once;
items that share a passage all come out; items shorter than the run length match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import ship, staged

ship(__name__)

WORDS = 13
MAX_ITEM_CHARS = 4_000_000
MASK_BITS = 24
#: Hits that are held at once (those of one document are held together); a passage that many items share may have many.
MAX_HITS = 250_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text):
    """Lower-cased runs of letters and digits, each followed by one blank, one blank in front."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _loads(buf: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word that starts at every byte; ``buf`` must have 8 spare bytes."""
    n = len(buf) - 7
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        part = buf[o : o + (n - o + 7) // 8 * 8]
        out[o::8] = part[: len(part) // 8 * 8].view("<u8")
    return out


def _hash(words: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` bytes (a multiple of 8) from each position."""
    h = np.zeros(len(at), np.uint64)
    for o in range(0, q, 8):
        h = (h ^ words[at + o]) * _A
        h ^= h >> np.uint64(29)
        h *= _B
    return h ^ (h >> np.uint64(32))


class Index:
    """Q-grams of a block of items, at every position."""

    def __init__(self, items: list[tuple[int, bytes]], words: int, k: int = 0):
        self.words, self.k = words, k
        items = [(i, t) for i, t in items if t.count(b" ") - 1 >= words]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.texts = [t for _, t in items]
        self.q = 0
        if not items:
            return
        # the shortest run of so many words (blanks at both ends included) bounds q and the step
        # k edited words leave one of k + 1 stretches with its share of the words untouched
        self.whole = whole = -(-(words - k) // (k + 1))
        shortest = min(self._shortest(t, whole) for t in self.texts)
        self.q = max(8, min(32, (shortest // 2 if k == 0 else shortest) // 8 * 8))
        # such a stretch holds so many q-grams, and a probe at every step-th position meets `probes` of them
        left = max(1, shortest - self.q + 1)
        self.step = max(1, min(8, left // 3))
        self.probes = max(1, left // self.step)
        self.starts = np.cumsum([0] + [len(t) for t in self.texts])
        flat = np.frombuffer(b"".join(self.texts) + b"\0" * 40, np.uint8)
        pos = np.concatenate([np.arange(s, max(s, e - self.q + 1)) for s, e in zip(self.starts, self.starts[1:])])
        h = _hash(_loads(flat), pos, self.q)
        order = np.argsort(h, kind="stable")
        self.h, self.pos = h[order], pos[order]
        self.mask = np.zeros(1 << MASK_BITS, bool)
        self.mask[(self.h >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True

    @staticmethod
    def _shortest(t: bytes, words: int) -> int:
        b = np.flatnonzero(np.frombuffer(t, np.uint8) == 32)
        return int((b[words:] - b[:-words]).min()) + 1

    def scan(self, flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(document number, item number) pairs that share a run of words; ``flat`` holds all texts."""
        if not self.q or len(flat) < self.q:
            return []
        at = np.arange(0, len(flat) - self.q + 1, self.step)
        buf = np.concatenate([flat, np.zeros(8, np.uint8)])
        h = _hash(_loads(buf), at, self.q)
        near = self.mask[(h >> np.uint64(64 - MASK_BITS)).astype(np.int64)]
        at, h = at[near], h[near]
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return []
        # documents in groups of at most MAX_HITS hits
        doc = np.searchsorted(offsets, at, "right") - 1
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        hits = np.add.reduceat(n, first)
        group = np.repeat((np.cumsum(hits) - hits) // MAX_HITS, np.diff(np.r_[first, len(at)]))
        cuts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(at)]
        return [pair for a, b in zip(cuts, cuts[1:]) for pair in self._met(flat, offsets, at[a:b], lo[a:b], n[a:b])]

    def _met(self, flat: np.ndarray, offsets: np.ndarray, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        """The verified pairs of whole documents' probes: their places, first entries in the index and numbers of entries."""
        rep = np.repeat(np.arange(len(at)), n)
        idx = lo[rep] + (np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n))
        p, d = self.pos[idx], at[rep]
        doc = np.searchsorted(offsets, d, "right") - 1
        inside = d + self.q <= offsets[doc + 1]
        p, d, doc = p[inside], d[inside], doc[inside]
        item = np.searchsorted(self.starts, p, "right") - 1
        width = 2 * self.k + 1
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        # bands of 2k+1 diagonals that overlap by k: with k = 0 a band is one diagonal
        for shift in {0, self.k}:
            band = (d - p + shift) // width
            order = np.lexsort((d, band, item, doc))
            o_doc, o_item, o_band, o_d, o_p = doc[order], item[order], band[order], d[order], p[order]
            new = np.ones(len(order), bool)
            new[1:] = (o_doc[1:] != o_doc[:-1]) | (o_item[1:] != o_item[:-1]) | (o_band[1:] != o_band[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(order)))
            for f, s in zip(first[size >= self.probes], size[size >= self.probes]):
                pairs.setdefault((int(o_doc[f]), int(o_item[f])), []).extend(zip(o_d[f : f + s].tolist(), o_p[f : f + s].tolist()))
        return [(dn, i) for (dn, i), hits in pairs.items() if self._verified(flat, offsets, dn, i, hits)]

    def _verified(self, flat: np.ndarray, offsets: np.ndarray, dn: int, i: int, hits: list[tuple[int, int]]) -> bool:
        text = flat[offsets[dn] : offsets[dn + 1]].tobytes()
        item = self.texts[i]
        done: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        sides: list[tuple[list[bytes], np.ndarray]] = []
        for d, p in sorted(hits):
            d, p = d - int(offsets[dn]), p - int(self.starts[i])
            if done.get(d - p, -1) >= d:
                continue  # the run of this diagonal was looked at
            a, b = self._run(text, item, d, p)
            done[d - p] = b
            run = text[a:b].count(b" ") - 1
            if run >= self.words:
                return True
            # one stretch of a run with edits is this long, and its own probes lead here
            if self.k and run >= self.whole:
                a += text[a:b].index(b" ")
                # the words of both sides, and the places of the blanks in front of them
                sides = sides or [(t[1:-1].split(b" "), np.flatnonzero(np.frombuffer(t, np.uint8) == 32)) for t in (text, item)]
                if self._aligned(*sides, a, a - (d - p), run, tried):
                    return True
        return False

    @staticmethod
    def _run(text: bytes, item: bytes, d: int, p: int) -> tuple[int, int]:
        """The longest common run around (d, p), in the text's positions."""
        n = min(d, p)
        x, y = np.frombuffer(text, np.uint8, n, d - n), np.frombuffer(item, np.uint8, n, p - n)
        bad = np.flatnonzero(x != y)
        a = d - n + (int(bad[-1]) + 1 if len(bad) else 0)
        m = min(len(text) - d, len(item) - p)
        x, y = np.frombuffer(text, np.uint8, m, d), np.frombuffer(item, np.uint8, m, p)
        bad = np.flatnonzero(x != y)
        return a, d + (int(bad[0]) if len(bad) else m)

    def _aligned(self, text: tuple[list[bytes], np.ndarray], item: tuple[list[bytes], np.ndarray], d: int, p: int, run: int, tried: set[tuple[int, int]]) -> bool:
        """Whether ``words`` of the item's words that share a stretch of the common run from p align with the text in at most k word edits."""
        (tw, tb), (iw, ib) = text, item
        ip, tp = int(np.searchsorted(ib, p, "right")) - 1, int(np.searchsorted(tb, d, "right")) - 1
        for s in range(max(0, ip + self.whole - self.words), min(ip + run - self.whole, len(iw) - self.words) + 1):
            q = iw[s : s + self.words]
            lo = max(0, tp - (ip - s) - self.k)
            if (s, lo) in tried:
                continue
            tried.add((s, lo))
            t = tw[lo : lo + self.words + 2 * self.k]
            here = set(t)
            if sum(w not in here for w in q) > self.k:
                continue  # each such word takes an edit
            if banded_distance(q, t, self.k) <= self.k:
                return True
        return False


def banded_distance(q: list, t: list, k: int) -> int:
    """Fewest edits that turn q into some stretch of t, within the band; k + 1 if more than k."""
    big = k + 1
    row = [0] * (len(t) + 1)
    for i, a in enumerate(q, 1):
        new = [min(i, big)] + [big] * len(t)
        for j in range(max(1, i - 2 * k), min(len(t), i + 2 * k) + 1):
            new[j] = min(row[j - 1] + (a != t[j - 1]), row[j] + 1, new[j - 1] + 1, big)
        row = new
        if min(row) > k:
            return big
    return min(row)


def _scanner(block, words: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process meets the same broadcast object in all its tasks and keeps the index with it
        ix = getattr(block, "_index", None)
        if ix is None:
            ix = Index(block.value, words, edits)
            block._index = ix
        for b in batches:
            col = b.column(1)
            if col.null_count or not len(col):
                col = col.fill_null("")
            kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
            offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
            data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(col) and col.buffers()[2] else np.zeros(0, np.uint8)
            offs = offs - offs[0]
            found = ix.scan(data, offs)
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in found], pa.int64()), pa.array([int(ix.ids[i]) for _, i in found], pa.int64())], names=["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, edits: int = 0, block_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id): documents with a run of ``words`` words of the item, up to ``edits`` word edits."""
    spark = documents.sparkSession
    docs = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text")).alias("text"))
    pool = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), words_of(F.col("text")).alias("text")).distinct()
    schema = "doc_id bigint, item_id bigint"
    scan = lambda sent: docs.mapInArrow(_scanner(sent, words, edits), schema).distinct()
    out: DataFrame | None = None
    blocks = _blocks(pool, block_chars)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        sent = spark.sparkContext.broadcast(block)
        if out is None and after is None:
            return scan(sent)  # one block: nothing needs to be written between
        part = staged(scan(sent), "leaks")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
        block = after
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def _blocks(pool: DataFrame, block_chars: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of bounded size; the driver holds the one in hand and the next."""
    block: list[tuple[int, bytes]] = []
    size = 0
    for r in pool.toLocalIterator():
        t = r.text.encode()
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, t))
        size += len(t)
    if block:
        yield block
