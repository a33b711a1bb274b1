"""Problem 5: the N best items of every group under one fixed tie rule.

Defined results: of rows with one id only the latest counts (ties on the time: the greater score,
then the greater group); null and NaN scores and rows without a batch are left out; -0.0 equals
0.0; equal scores are ordered by id; an empty table gives an empty result; a null pillar is a
group of its own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.positions import first_positions


def latest_rows(atoms: DataFrame) -> DataFrame:
    """(id, pillar, batch_id, score) of the latest row of every id."""
    pillar = F.upper(F.regexp_replace("primary_pillar", r"(?U)^\s+|\s+$", ""))
    best = F.max(F.struct(F.col("updated_at").alias("t"), F.col("virality_score").alias("score"), pillar.alias("pillar"), F.col("source_metadata.batch_id").alias("batch_id")))
    return atoms.groupBy("id").agg(best.alias("b")).select("id", "b.pillar", "b.batch_id", "b.score")


def top_items(atoms: DataFrame, n: int = 3) -> DataFrame:
    """id, pillar, batch_id, score, position for positions 1..n of every (pillar, batch_id)."""
    rows = latest_rows(atoms).filter("score is not null and not isnan(score) and batch_id is not null and id is not null")
    rows = rows.withColumn("score", F.when(F.col("score") == 0, F.lit(0.0)).otherwise(F.col("score")))
    return first_positions(rows, ["pillar", "batch_id"], [F.col("score").desc(), F.col("id").asc()], n)
