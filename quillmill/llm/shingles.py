"""Hashed sets of consecutive words, computed over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.runtime import ship

ship(__name__)

#: Bytes of text that are hashed at once (a longer text is hashed alone).
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, each followed by one blank, one blank in front."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of every ``k`` consecutive words of texts prepared by ``words_of``."""

    def __init__(self, k: int):
        self.k, self.size = k, 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, CHUNK)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(self.size + 1, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def chunks(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, words per row, row of each shingle, hash of each shingle)."""
        a, n = 0, len(offs) - 1
        while a < n:
            b = int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1
            b = min(n, max(a + 1, b))
            yield a, b, *self._hashed(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            a = b

    def _hashed(self, flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = len(offs) - 1
        self._powers(len(flat))
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(flat.astype(np.uint64) * self.up[: len(flat)], out=sums[1:])
        blank = np.flatnonzero(flat == 32)
        row = np.searchsorted(offs, blank, "right") - 1
        words = np.maximum(np.bincount(row, minlength=rows) - 1, 0)
        # a text without a word is two blanks
        words[np.diff(offs) <= 2] = 0
        k = self.k
        if len(blank) <= k:
            return words, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        same = row[k:] == row[:-k]
        s, e, r = blank[:-k][same] + 1, blank[k:][same], row[:-k][same]
        return words, r, mixed((sums[e] - sums[s]) * self.down[s] + np.uint64(0x51ED270B))


def distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys sorted, each key once per row."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[keep], key[keep]
