"""Problem 6: new batches judged against all that is accepted already.

The metric is the Jaccard distance of sets of three consecutive words. Every text has a row in a
pivot table: its distances to fixed pivots (the empty set, and the sixteen slices of the shingle
space: |A| and |A n slice|), the least positions of its set on 128 fixed random lines, and the set
itself. History keeps its rows (``append`` writes a batch's own beside them); a batch is judged from its
own texts and the stored rows, and no text is read twice.

Why the lines: distances to any fixed pivot concentrate so much in this space (unrelated texts lie
at 0.9 to 1.0 of one another) that a range join on them alone leaves nearly all pairs. Near sets
agree in a line's least position with probability 1 - distance; four such positions make a key, 32
keys are joined. A pair at the threshold is missed with probability (1 - 0.7^4)^32 = 0.00015. The
joined pairs are pruned by the triangle inequality against the pivots, and what remains is verified
by the true distance of the stored sets, which are those of the whole texts.

Exact copies form classes first, so a text that a third of all rows share is one class: pairs are
pairs of classes, and members are judged by their class's earliest rows.

Defined results: null, blank and short texts (under 20 words) repeat nothing by content; null and
bare addresses name no page; ERROR rows don't count; an id delivered twice counts once and never
repeats itself; of equal times the lower id is the earlier; a null time is earlier than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.positions import first_positions
from quillmill.llm.shingles import Hasher, buffers, distinct, mixed, words_of
from quillmill.runtime import ship, staged

ship(__name__)
ship("quillmill.llm.shingles")

K, MIN_WORDS = 3, 20
ROWS, BANDS, SLICES = 4, 32, 16
#: Classes of a crowded key that a query meets in the first round.
LEADERS = 32
#: Similarity of 7/10 in whole numbers.
NUM, DEN = 7, 10
#: Bytes of a stored shingle: in one of a thousand pairs of sets of half a million, one shingle would agree by chance.
WIDTH = 6
#: Lines: odd multipliers and offsets from a fixed seed.
_RNG = np.random.RandomState(20240)
_MUL = (_RNG.randint(0, 1 << 62, ROWS * BANDS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.randint(0, 1 << 62, ROWS * BANDS).astype(np.uint64)

_TABLE = "src string, id string, kind int, ts timestamp, size int, fp bigint, slices array<int>, bands array<bigint>, shingles binary"


def pivot_rows(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have a set, sizes, fingerprints, slice counts, band keys) of sorted distinct sets."""
    size = np.bincount(row, minlength=rows)
    have = np.flatnonzero(size)
    start = np.concatenate([[0], np.cumsum(size[have])[:-1]]).astype(np.int64)
    fp = np.add.reduceat(mixed(key), start)
    slices = np.bincount(row * SLICES + (key & np.uint64(SLICES - 1)).astype(np.int64), minlength=rows * SLICES).reshape(rows, SLICES)[have]
    bands = np.empty((len(have), BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(len(have), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            low = np.minimum.reduceat((key * _MUL[j] + _ADD[j]) ^ (key >> np.uint64(31)), start)
            acc = mixed(acc ^ low)
        bands[:, b] = acc
    return have, size[have], fp, slices, bands


def _tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(K)
    for batch in batches:
        data, offs = buffers(batch.column(4))
        for a, b, words, row, h in hasher.chunks(data, offs):
            ok = words[row] >= MIN_WORDS
            row, key = distinct(row[ok], h[ok])
            if not len(row):
                continue
            have, size, fp, slices, bands = pivot_rows(row, key, b - a)
            take = pa.array(have + a)
            n = len(have)
            lists = lambda m, k, t: pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(m.reshape(-1).astype(t)))  # noqa: B023, E731
            packed = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :WIDTH])
            ends = np.concatenate([[0], np.cumsum(size)]) * WIDTH
            sets = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(4)), pa.array(size.astype(np.int32)), pa.array(fp.view(np.int64)), lists(slices, SLICES, np.int32), lists(bands.view(np.int64), BANDS, np.int64), sets],
                names=["src", "id", "kind", "ts", "size", "fp", "slices", "bands", "shingles"],
            )


def pivot_table(rows: DataFrame) -> DataFrame:
    """The pivot table's rows of texts (src, id, kind, ts, text); to be appended to the history's."""
    texts = rows.filter(F.col("text").isNotNull()).select("src", "id", "kind", "ts", words_of(F.col("text")).alias("text"))
    return texts.mapInArrow(_tabulate, _TABLE)


def append(table_path: str, rows: DataFrame) -> None:
    """Stores the pivot rows of a batch (src, id, kind, ts, text) beside the history's; only the batch's texts are read."""
    pivot_table(rows).write.mode("append").parquet(table_path)


def stored(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.schema(_TABLE).parquet(table_path)


def classes(table: DataFrame) -> DataFrame:
    """One row per set: its pivots, its earliest rows."""
    hist = F.when(F.col("kind") == 0, F.col("id"))
    new = F.when(F.col("kind") == 1, F.struct("ts", "id"))
    return table.groupBy("fp", "size").agg(F.first("slices").alias("slices"), F.first("bands").alias("bands"), F.min(hist).alias("h1"), F.max(hist).alias("h2"), F.min(new).alias("n1"))


def band_entries(cls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of a query's first round, entries left for the second): fp, size, band.

    A key that more than ``LEADERS`` classes share (a template with a changing date, say) would pair
    them all. Its classes are ranked, accepted and early ones first, over as many tasks as they need,
    and the first round meets the leaders only; queries that they don't settle meet the rest in the second.
    """
    entries = cls.select("fp", "size", F.col("h1").isNull().alias("late"), F.col("n1.ts").alias("ts"), F.explode("bands").alias("band"))
    crowded = staged(entries.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEADERS).select("band"), "crowded")
    if crowded.isEmpty():
        return entries.select("fp", "size", "band"), entries.limit(0).select("fp", "size", "band")
    among = staged(entries.join(crowded, "band"), "among")
    leaders = staged(first_positions(among, ["band"], [F.col("late").asc(), F.col("ts").asc_nulls_first(), F.col("fp").asc(), F.col("size").asc()], LEADERS).select("fp", "size", "band"), "leaders")
    first = entries.join(crowded, "band", "left_anti").select("fp", "size", "band").unionByName(leaders)
    return first, among.select("fp", "size", "band").join(leaders, ["fp", "size", "band"], "left_anti")


def near_classes(cls: DataFrame, queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(q, x): pairs of a query class and another that share a band and that no pivot separates.

    ``queries``: fp of the classes that ask; ``entries``: fp, size, band of those asked.
    """
    info = cls.select("fp", "size", "slices")
    a = cls.join(queries, "fp", "left_semi").select(F.col("fp").alias("q"), F.col("size").alias("qs"), F.explode("bands").alias("band"))
    b = entries.select(F.col("fp").alias("x"), F.col("size").alias("xs"), "band")
    # the pivot "empty set": |A| and |B| differ by at most the distance allowed
    pairs = a.join(b, "band").filter((F.col("q") != F.col("x")) & (F.col("qs") * DEN >= F.col("xs") * NUM) & (F.col("xs") * DEN >= F.col("qs") * NUM)).select("q", "x").distinct()
    pairs = pairs.join(info.select(F.col("fp").alias("q"), F.col("size").alias("qs"), F.col("slices").alias("qv")), "q").join(info.select(F.col("fp").alias("x"), F.col("size").alias("xs"), F.col("slices").alias("xv")), "x")
    # the slices: the differences of the distances add up to no more than |A - B| + |B - A|
    apart = F.aggregate(F.zip_with("qv", "xv", lambda u, v: F.abs(u.cast("int") - v.cast("int"))), F.lit(0), lambda s, v: s + v)
    return pairs.filter(apart * (NUM + DEN) <= (F.col("qs") + F.col("xs")) * (DEN - NUM)).select("q", "x")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets share enough of their union."""

    def numbers(b: pa.Buffer) -> np.ndarray:
        out = np.zeros((b.size // WIDTH, 8), np.uint8)
        out[:, :WIDTH] = np.frombuffer(b, np.uint8).reshape(-1, WIDTH)
        return out.view(np.uint64)[:, 0]

    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3)):
            both = np.concatenate([numbers(a.as_buffer()), numbers(b.as_buffer())])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(common * (NUM + DEN) >= len(both) * NUM)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(q, x) of the pairs whose true similarity reaches the threshold, by the stored sets."""
    ends = pairs.select(F.col("q").alias("fp")).union(pairs.select("x")).distinct()
    sets = table.select("fp", "shingles").join(ends, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    sets = staged(sets, "sets")
    both = pairs.join(sets.select(F.col("fp").alias("q"), F.col("shingles").alias("a")), "q").join(sets.select(F.col("fp").alias("x"), F.col("shingles").alias("b")), "x")
    return both.select("q", "x", "a", "b").mapInArrow(_near, "q bigint, x bigint")


def by_content(rows: DataFrame, history_table: DataFrame | None = None) -> DataFrame:
    """ids of the new rows (kind 1) that repeat accepted or earlier content.

    ``rows``: src, id, kind, ts, text. With a ``history_table`` (the rows of earlier batches, as ``append``
    stores them) ``rows`` are the batch alone, and no text of the history is read.
    """
    fresh = staged(pivot_table(rows if history_table is None else rows.filter("kind = 1")), "pivots")
    table = fresh if history_table is None else history_table.unionByName(fresh)
    cls = staged(classes(table), "classes")
    new = fresh.filter("kind = 1").select("id", "ts", F.col("fp").alias("q")).distinct()
    first, rest = band_entries(cls)
    asking = new.select(F.col("q").alias("fp")).distinct()
    itself = asking.select(F.col("fp").alias("q"), F.col("fp").alias("x"))
    links = verified(staged(near_classes(cls, asking, first), "pairs"), table).unionByName(itself)
    found = _settled(new, links, cls)
    if rest.isEmpty():
        return found
    found = staged(found, "found")
    open_ = new.join(found, "id", "left_anti")
    pairs = staged(near_classes(cls, open_.select(F.col("q").alias("fp")).distinct(), rest), "pairs")
    if pairs.isEmpty():
        return found
    return found.unionByName(_settled(open_, verified(pairs, table), cls)).distinct()


def _settled(new: DataFrame, links: DataFrame, cls: DataFrame) -> DataFrame:
    """ids of the new rows that repeat a row of a class linked to theirs."""
    near = links.join(cls.select(F.col("fp").alias("x"), "h1", "h2", "n1"), "x")
    near = near.groupBy("q").agg(F.min("h1").alias("h1"), F.max("h2").alias("h2"), F.min("n1").alias("n1"))
    return new.join(near, "q").filter(_repeats()).select("id").distinct()


def _repeats() -> Column:
    """An accepted row of another id, or an earlier new row."""
    other = (F.col("h1").isNotNull() & (F.col("h1") != F.col("id"))) | (F.col("h2").isNotNull() & (F.col("h2") != F.col("id")))
    earlier = F.col("n1").isNotNull() & (F.col("n1") < F.struct("ts", "id")) & (F.col("n1.id") != F.col("id"))
    return other | earlier


def page_key(url: Column) -> Column:
    """The page an address names, null if it names none."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:(?=//)", "")
    rest = F.regexp_replace(rest, r"^//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(?:www\.|m\.)+", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?:^|&)((?:p|id|v)=[^&]+)"), F.lit(1)))), "&")
    return F.when((host != "") & ((path != "") | (kept != "")), F.concat_ws(" ", host, path, kept))


def by_address(rows: DataFrame) -> DataFrame:
    """ids of the new rows whose address names a page of another accepted or earlier row (id, kind, ts, url)."""
    keyed = rows.select("id", "kind", "ts", page_key(F.col("url")).alias("q")).filter("q is not null")
    hist, new = F.when(F.col("kind") == 0, F.col("id")), F.when(F.col("kind") == 1, F.struct("ts", "id"))
    near = keyed.groupBy("q").agg(F.min(hist).alias("h1"), F.max(hist).alias("h2"), F.min(new).alias("n1"))
    return keyed.filter("kind = 1").distinct().join(near, "q").filter(_repeats()).select("id").distinct()
