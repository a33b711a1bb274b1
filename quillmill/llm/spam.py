"""Problem 10: keyword-stuffed pages, link lists and tag lists.

Every text is compressed in blocks of ``BLOCK`` bytes after addresses, mark-up and the words of hash tags
are reduced to one letter each and figures to one figure. The bytes that all blocks compress to, over the
bytes of the whole text as it stands, are its compression ratio: links and tags that vary count as redundant,
as they say nothing. The ratio is divided by what prose of that language and length compresses to; extreme
redundancy is a suspicion, which low sentence-punctuation density confirms. What takes most of the text
(links, tags, else repetition) names the reason.

Sentences stuffed with one keyword keep their punctuation, so there the method can't confirm: a ratio under
that of prose and the share of the most repeated keyword decide.

Defined results: null and empty texts are no cases; the language is told by its function words, not
by the (dirty) column; texts of any length are read whole; ids delivered twice count once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common_words import WORDS
from quillmill.runtime import ship

ship(__name__)
ship("quillmill.llm.common_words")

BLOCK = 2048
#: Ratio that prose of a language approaches in full blocks; short texts compress less.
PROSE_RATIO = {"en": 0.46, "de": 0.37, "es": 0.36, "fr": 0.36}
REDUNDANT, STUFFED = 0.7, 1.0
LOW_PUNCTUATION = 0.03
LINK_SHARE, TAG_SHARE = 0.5, 0.5
KEY_PAIR, KEY_WORD = 0.12, 0.06
#: Share of function words from which a text without punctuation is speech.
SPOKEN = 0.3

_URL = re.compile(r"https?://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+")
_TAG = re.compile(r"<[^<>]+>")
_NUM = re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…][\"”’»)]*(?=\s|$)")
_HASH = re.compile(r"#\w+")
_COMMON = {k: frozenset(v) for k, v in WORDS.items()}
_ANY = frozenset(w for v in WORDS.values() for w in v)


def language(words: list[str]) -> str:
    seen = Counter(words)
    return max(_COMMON, key=lambda k: (sum(seen[w] for w in _COMMON[k]), k == "en"))


def compressed(masked: bytes) -> int:
    """The bytes that the blocks compress to."""
    return sum(len(zlib.compress(masked[i : i + BLOCK], 6)) for i in range(0, len(masked), BLOCK))


def expected_ratio(lang: str, size: int) -> float:
    """What prose of this language and masked size compresses to."""
    return PROSE_RATIO[lang] + 2.2 / math.sqrt(max(64, min(size, BLOCK))) - 2.2 / math.sqrt(BLOCK)


def judge(text: str | None) -> tuple | None:
    """(words, ratio, normal ratio, punctuation density, link share, tag share, keyword share, reason or None)."""
    if not text:
        return None
    urls = _URL.findall(text)
    masked = _URL.sub(" u ", text) if urls else text
    tags = _TAG.findall(masked) if "<" in masked else []
    if tags:
        masked = _TAG.sub(" t ", masked)
    hashes = _HASH.findall(masked) if "#" in masked else []
    words = _WORD.findall(_NUM.sub("0", masked).lower())
    n = len(words)
    if not n:
        return None
    if hashes:
        masked = _HASH.sub("#", masked)
    masked = _NUM.sub("0", masked).lower()
    whole = len(text.encode("utf-8", "replace"))
    ratio = compressed(masked.encode("utf-8", "replace")) / whole
    lang = language(words)
    normal = ratio / expected_ratio(lang, whole)
    ended = len(_END.findall(text)) / n
    link_share = (sum(map(len, urls)) + sum(map(len, tags))) / len(text)
    tag_share = sum(map(len, hashes)) / len(text)
    top, pairs = Counter(w for w in words if len(w) > 3 and w not in _ANY), Counter((a, b) for a, b in zip(words, words[1:]) if a not in _ANY and b not in _ANY)
    one, two = max(top.values(), default=0) / n, max(pairs.values(), default=0) * 2 / n
    key = max(one, two / 2)
    reason = None
    if normal <= REDUNDANT and ended < LOW_PUNCTUATION:
        # speech without punctuation has its function words; keyword, link and tag lists have not
        spoken = sum(map(_ANY.__contains__, words)) >= SPOKEN * n and normal > REDUNDANT * 0.6
        if not spoken:
            reason = "links" if link_share >= LINK_SHARE else "tags" if tag_share >= TAG_SHARE else "redundant"
    elif normal <= STUFFED and (two >= KEY_PAIR or one >= KEY_WORD):
        reason = "stuffed"
    return n, ratio, normal, ended, link_share, tag_share, key, reason


_SCHEMA = "doc_id bigint, words int, ratio double, normal double, ended double, link_share double, tag_share double, key_share double, reason string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.float64()] * 6, pa.string()]
    for b in batches:
        rows = [(i, *r) for i, r in zip(b.column(0).to_pylist(), map(judge, b.column(1).to_pylist())) if r]
        cols = list(zip(*rows)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)


def judged(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of measures per non-empty document; ``reason`` is null unless it is spam."""
    return documents.filter(F.col(text) != "").select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_run, _SCHEMA)


def spam(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return judged(documents, id_col, text).filter("reason is not null").select("doc_id").distinct()
