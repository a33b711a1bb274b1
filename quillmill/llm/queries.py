"""The pN_ queries: every operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import history, leakage, main_body, packing, quality, repeated_lines, scanned, spam, split_items, top_n
from quillmill.runtime import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(spread(table(spark, d, "content_reservoir")))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated(spread(table(spark, d, "content_reservoir"))).dropDuplicates(["id"]).select("id", F.length("raw_text").alias("chars_before"), F.length("clean_text").alias("chars_after"), "clean_text")


def _p2(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str]]:
    return [(spread(table(spark, d, "content_reservoir")), "id", "raw_text"), (table(spark, d, "chunks"), "doc_id", "text")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (split_items.oversized(t, i, x) for t, i, x in _p2(spark, d))
    return a.union(b).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    a, b = (split_items.split_items(t.dropDuplicates([i, "chunk_index"]), i, x) for t, i, x in _p2(spark, d))
    return a.union(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.found_defects(spread(table(spark, d, "extraction_results")), table(spark, d, "chunks"), ["doc_id", "chunk_index"])


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repaired(spread(table(spark, d, "extraction_results")), table(spark, d, "chunks"), ["doc_id", "chunk_index"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.top_items(table(spark, d, "content_atoms"), 3).select("id").distinct()


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return top_n.top_items(table(spark, d, "content_atoms"), 3)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    author = F.concat(F.lit("a:"), repeated_lines.author_key(F.col("source_author")))
    blog = spread(table(spark, d, "content_reservoir")).filter("source_type = 'BLOG'").select(F.col("id").alias("item_id"), F.col("raw_text").alias("text"), F.col("raw_title").alias("title"), author.alias("source"))
    return blog.union(spread(table(spark, d, "raw_ingest")).select("id", "raw_content", "raw_title", main_body.source_of_url(F.col("source_url"))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return main_body.furniture(_pages(spark, d))


def p3_bodies(spark: SparkSession, d: str) -> DataFrame:
    return main_body.main_bodies(_pages(spark, d)).drop("text")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """src, id, kind (0 accepted, 1 new), ts, text, url of all rows that count."""
    old = spread(table(spark, d, "content_reservoir")).select(F.lit("reservoir").alias("src"), "id", F.lit(0).alias("kind"), F.lit(None).cast("timestamp").alias("ts"), F.col("raw_text").alias("text"), F.lit(None).cast("string").alias("url"))
    kind = F.when(F.col("status") == "PENDING", 1).otherwise(0)
    raw = spread(table(spark, d, "raw_ingest")).filter("status in ('PASSED', 'PENDING') and id is not null")
    return old.union(raw.select(F.lit("ingest"), "id", kind, F.when(kind == 1, F.col("ingested_at")), "raw_content", "source_url"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _arrivals(spark, d)
    return history.by_content(rows.drop("url")).union(history.by_address(rows.drop("text"))).distinct()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    a = spread(table(spark, d, "content_reservoir")).select(F.col("id").alias("item_id"), F.col("raw_text").alias("text"))
    return a.union(spread(table(spark, d, "raw_ingest")).select("id", "raw_content"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.junk(_texts(spark, d), "item_id", "text").distinct()


def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_statistics(_texts(spark, d), "text").drop("text").dropDuplicates(["item_id"])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(spread(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.packed(spread(table(spark, d, "documents"))))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Runs of 13 words of an item with at most one word edited."""
    return leakage.leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items"), edits=1)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam(spread(table(spark, d, "documents")))


def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    return spam.judged(spread(table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}
