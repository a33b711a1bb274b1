"""Chunking (C1-C5): ordered folds that carry boundary indexes, never text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import lexicons as L
from quillmill.functions.text import any_of, stripped, word_count, words


def paragraph_chunks(docs: DataFrame, id_col: str, text: str, separator: str = "\n\n", least: int = 250, most: int = 900, hard: int = 1100, early: list[str] | None = None) -> DataFrame:
    """Paragraphs gathered until a chunk is full, or a closing phrase ends it early.

    Columns: id, index, text, word_count, paragraph_count, start_paragraph, end_paragraph,
    closed_early, early_close_reason. A rest under ``least`` words joins the chunk before.
    """
    phrase = "(?i)" + any_of(L.EARLY_CLOSE if early is None else early)
    base = docs.select(F.col(id_col).alias("__id"), F.filter(F.transform(F.split(F.col(text), separator, -1), stripped), lambda p: p != "").alias("ps"))
    base = base.withColumn("w", F.transform("ps", word_count)).withColumn("hit", F.transform("ps", lambda p: F.regexp_extract(F.lower(p), phrase, 0)))
    chunk = "struct<words:int,first:int,last:int,early:boolean,reason:string>"
    acc = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("sum"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        total = (s["sum"] + x["w"]).cast("int")
        phrase_hit = (total < hard) & (total >= least) & (x["hit"] != "")
        close = (total >= hard) | phrase_hit | (total >= most)
        one = F.struct(total.alias("words"), s["first"].alias("first"), s["at"].alias("last"), phrase_hit.alias("early"), F.when(phrase_hit, x["hit"]).alias("reason")).cast(chunk)
        return F.struct(
            F.when(close, F.concat(s["done"], F.array(one))).otherwise(s["done"]).alias("done"),
            F.when(close, s["at"] + 1).otherwise(s["first"]).cast("int").alias("first"),
            F.when(close, 0).otherwise(total).cast("int").alias("sum"),
            (s["at"] + 1).cast("int").alias("at"),
        )

    def finish(s: Column) -> Column:
        n = F.size(s["done"])
        rest = F.struct(s["sum"].alias("words"), s["first"].alias("first"), (s["at"] - 1).alias("last"), F.lit(False).alias("early"), F.lit(None).cast("string").alias("reason")).cast(chunk)
        before = F.get(s["done"], n - 1)
        merged = F.struct((before["words"] + s["sum"]).alias("words"), before["first"].alias("first"), (s["at"] - 1).alias("last"), F.lit(False).alias("early"), F.lit(None).cast("string").alias("reason")).cast(chunk)
        left = s["at"] > s["first"]
        return F.when(~left, s["done"]).when((s["sum"] >= least) | (n == 0), F.concat(s["done"], F.array(rest))).otherwise(F.concat(F.slice(s["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(merged)))

    folded = base.withColumn("c", F.aggregate(F.arrays_zip("w", "hit"), acc, step, finish))
    # outer: for the inner form the planner would test the whole fold below the projection, and compute it twice
    out = folded.select("__id", "ps", F.posexplode_outer("c").alias("index", "c")).filter("c is not null")
    return out.select(
        F.col("__id").alias(id_col), "index",
        F.array_join(F.slice("ps", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), separator).alias("text"),
        F.col("c.words").alias("word_count"), (F.col("c.last") - F.col("c.first") + 1).alias("paragraph_count"),
        F.col("c.first").alias("start_paragraph"), F.col("c.last").alias("end_paragraph"), F.col("c.early").alias("closed_early"), F.col("c.reason").alias("early_close_reason"),
    )


def chunk_stats(chunks: DataFrame, id_col: str) -> DataFrame:
    """C3 per document."""
    return chunks.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("word_count").alias("words"), F.sum("paragraph_count").alias("paragraphs"),
        F.avg("word_count").alias("avg_words"), F.count_if("closed_early").alias("early"),
    )


def window_chunks(docs: DataFrame, id_col: str, text: str, title: str | None = None, size: int = 2000, overlap: int = 100) -> DataFrame:
    """Fixed windows of words with an overlap; short texts stay as they are; parts get a title suffix."""
    df = docs.filter(F.col(text).isNotNull()).withColumn("__w", words(F.col(text))).withColumn("__n", F.size("__w"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("__n") - (overlap + 1), F.lit(0)), F.lit(size - overlap))
    df = df.withColumn("__s", F.when(F.col("__n") <= size, F.array(F.lit(0))).otherwise(starts))
    df = df.select(*docs.columns, "__w", "__n", F.size("__s").alias("parts"), F.posexplode_outer("__s").alias("part", "__at"))
    piece = F.when(F.col("__n") <= size, F.col(text)).otherwise(F.array_join(F.slice("__w", F.col("__at") + 1, size), " "))
    df = df.withColumn("chunk", piece)
    if title:
        df = df.withColumn("chunk_title", F.when(F.col("parts") > 1, F.format_string("%s (Part %d/%d)", F.col(title), F.col("part") + 1, F.col("parts"))).otherwise(F.col(title)))
    return df.drop("__w", "__n", "__at")
