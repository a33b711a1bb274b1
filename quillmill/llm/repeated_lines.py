"""Problem 1: lines an author repeats across items, found and removed.

Every line's documents are held as compressed bitmaps per author. A document gets an ordinal;
ordinals are cut into containers of 2**15, and a container is a position array while it is
sparse and a 4 KB bitmap once it is dense. Containers of the variants of a line (spellings that
normalise alike) are united, container cardinalities add up to the exact number of documents, and
the lines of a document are deleted by looking its bit up in the repeated lines' containers.
No task ever holds more than one container of a line, so a line in a third of all documents is
spread over as many tasks as it has containers.

Defined results: null texts and rows without an author take no part; an id delivered twice counts
once (its lines are united); a line repeated within one document counts once; empty tables give
empty results; extra columns pass through ``without_repeated`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import staged

BITS = 15
#: Positions up to which a container stays an array; above, 4 KB of bits take less room.
ARRAY_MAX = 2048


#: White space but for the line feed, no-break spaces included.
BLANK = r"[ \t\x0B\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: What is neither letter nor digit at a line's start or end; runs are tried once, so this is linear.
EDGES = r"(?md)^[^\p{L}\p{N}\n]++|(?<![^\p{L}\p{N}\n])[^\p{L}\p{N}\n]++$"


def author_key(author: Column) -> Column:
    """Authors compared without case and without surrounding or repeated white space; null if nothing is left."""
    norm = F.trim(F.regexp_replace(F.lower(author), BLANK.replace("[ ", "[ \\n"), " "))
    return F.when(F.length(norm) > 0, norm)


def normalised_lines(text: Column) -> Column:
    """The text's lines, lower-cased, digits as one, blanks as one, bare of edge characters."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), BLANK, " "), r"\p{Nd}+", "0")
    return F.split(F.regexp_replace(flat, EDGES, ""), "\n", -1)


def document_lines(items: DataFrame, id_col: str, text: str, author: str) -> DataFrame:
    """(author, id, doc, lines array<struct<k, v, n>>): one row per document, staged once.

    k is the key of the normalised line, v that of the line as it stands, n its number; doc is the
    document's ordinal, dense within a partition. Only keys travel, never the texts.
    """
    a = author_key(F.col(author))
    lines = F.arrays_zip(normalised_lines(F.col(text)).alias("norm"), F.split(F.col(text), "\n", -1).alias("raw"))
    packed = F.filter(
        F.transform(lines, lambda x, i: F.struct(F.when(x["norm"] != "", F.xxhash64(x["norm"])).alias("k"), F.hash(x["raw"]).alias("v"), i.alias("n"))),
        lambda x: x["k"].isNotNull(),
    )
    rows = items.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), a.alias("author"), packed.alias("lines")).filter("author is not null")
    once = rows.groupBy("id", "author").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    # the ordinal is fixed by the written table, not by a recomputation
    return staged(once.withColumn("doc", F.monotonically_increasing_id()).withColumn("author_key", F.xxhash64("author")), "lines")


def _entries(docs: DataFrame) -> DataFrame:
    return docs.select("author_key", "id", "doc", F.explode("lines").alias("l")).select(
        "author_key", F.col("l.k").alias("k"), F.col("l.v").alias("v"), F.col("l.n").alias("line_no"),
        F.shiftright("doc", BITS).alias("container"), F.col("doc").bitwiseAND((1 << BITS) - 1).cast("smallint").alias("pos"), "id",
    )


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """(author_key, k, container, positions, bits, card): the united containers of every line.

    A sparse container has ``positions`` and null ``bits``, a dense one the reverse.
    """
    key = ["author_key", "k", "container"]
    variants = _entries(docs).repartition(*key).groupBy(*key, "v").agg(F.collect_set("pos").alias("positions"))
    united = variants.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"))
    united = united.withColumn("card", F.size("positions"))
    sparse = united.filter(F.col("card") <= ARRAY_MAX).select(*key, "card", "positions", F.lit(None).cast("binary").alias("bits"))
    dense = (
        united.filter(F.col("card") > ARRAY_MAX).select(*key, "card", F.explode("positions").alias("pos"))
        .groupBy(*key, "card").agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("bits"))
        .select(*key, "card", F.lit(None).cast("array<smallint>").alias("positions"), "bits")
    )
    return sparse.unionByName(dense)


def has_bit() -> Column:
    """Whether the container at hand holds ``pos``."""
    byte = F.expr("conv(hex(substring(bits, pos div 8 + 1, 1)), 16, 10)").cast("int")
    bit = F.expr("1 << (pos % 8)")
    return F.when(F.col("bits").isNull(), F.expr("array_contains(positions, pos)")).otherwise(byte.bitwiseAND(bit) != 0)


def repeated_containers(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """Containers of the lines whose exact cardinality within their author reaches ``min_docs``."""
    maps = line_bitmaps(docs)
    total = maps.groupBy("author_key", "k").agg(F.sum("card").alias("docs")).filter(F.col("docs") >= min_docs)
    return maps.join(total, ["author_key", "k"])


def _hits(docs: DataFrame, min_docs: int) -> DataFrame:
    hot = repeated_containers(docs, min_docs).select("author_key", "k", "container", "positions", "bits")
    return _entries(docs).join(hot, ["author_key", "k", "container"]).filter(has_bit())


def repeated_lines(items: DataFrame, id_col: str = "id", text: str = "raw_text", author: str = "source_author", min_docs: int = 5) -> DataFrame:
    """(item_id, line_no) of every occurrence of a line its author uses in ``min_docs`` documents or more."""
    hit = _hits(document_lines(items, id_col, text, author), min_docs)
    return hit.select(F.col("id").alias("item_id"), F.col("line_no").cast("int").alias("line_no")).distinct()


def without_repeated(items: DataFrame, id_col: str = "id", text: str = "raw_text", author: str = "source_author", min_docs: int = 5, out: str = "clean_text") -> DataFrame:
    """The items with one more column: their text without the lines their author repeats."""
    hit = _hits(document_lines(items, id_col, text, author), min_docs)
    cut = hit.groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_no").alias("__cut"))
    kept = F.expr(f"array_join(filter(split(`{text}`, '\\n', -1), (x, i) -> not array_contains(__cut, i)), '\\n')")
    joined = items.join(cut, F.col(id_col) == F.col("__id"), "left")
    return joined.withColumn(out, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(kept)).drop("__id", "__cut")
