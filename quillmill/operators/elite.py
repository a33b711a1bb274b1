"""Competitive selection of the best chunks of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Axis, quota of newly chosen chunks, least score.
AXES = [("punch", 8, 25), ("identity", 6, 20), ("tension", 6, 30), ("quotability", 5, 35), ("novelty", 5, 0)]


def elite(scored: DataFrame, doc: str, index: str, axes=AXES, fill_to: int = 15, cap: int = 35, fill_total: int = 80, fill_edge: int = 50) -> DataFrame:
    """Chosen rows with ``axes`` (labels) and ``adjusted_total``.

    Axis by axis, rows are walked by score; a row already chosen on the way gains the label and
    costs nothing of the quota. The greedy walk is a running count of new rows before the row, so
    it is one window per axis over the document's partition. A document's chunks are bounded by
    its length; all windows share one partitioning.
    """
    df = scored.withColumn("axes", F.array().cast("array<string>"))
    for name, quota, least in axes:
        order = Window.partitionBy(doc).orderBy(F.desc(name), F.asc(index)).rowsBetween(Window.unboundedPreceding, -1)
        fresh = ((F.size("axes") == 0) & (F.col(name) >= least)).cast("int")
        df = df.withColumn("__before", F.coalesce(F.sum(fresh).over(order), F.lit(0)))
        takes = (F.col("__before") < quota) & (F.col(name) >= least)
        df = df.withColumn("axes", F.when(takes, F.concat("axes", F.array(F.lit(name)))).otherwise(F.col("axes"))).drop("__before")
    whole = Window.partitionBy(doc)
    df = df.withColumn("__chosen", F.sum((F.size("axes") > 0).cast("int")).over(whole))
    able = (F.size("axes") == 0) & (F.col("total") >= fill_total) & (F.col("identity") + F.col("tension") >= fill_edge)
    rank = F.row_number().over(Window.partitionBy(doc, able).orderBy(F.desc("total"), F.asc(index)))
    df = df.withColumn("axes", F.when(able & (rank <= fill_to - F.col("__chosen")), F.array(F.lit("fill"))).otherwise(F.col("axes")))
    df = df.filter(F.size("axes") > 0).withColumn("adjusted_total", F.col("total") + F.when(F.size("axes") >= 2, 25).otherwise(0))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("adjusted_total"), F.asc(index)))
    return df.withColumn("__place", place).filter(F.col("__place") <= cap).drop("__place", "__chosen")


def selection_stats(gated: DataFrame, chosen: DataFrame, doc: str, gate: str = "passes", few: int = 15) -> DataFrame:
    """Per document the chunks lost at the gate and in the ranking, the chosen, and low yield."""
    a = gated.groupBy(doc).agg(F.count_if(~F.col(gate)).alias("lost_at_gate"), F.count_if(gate).alias("passed"))
    b = chosen.groupBy(doc).agg(F.count(F.lit(1)).alias("chosen"))
    j = a.join(b, doc, "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))
    return j.select(doc, "lost_at_gate", (F.col("passed") - F.col("chosen")).alias("lost_in_ranking"), "chosen", (F.col("chosen") < few).alias("low_yield"))
