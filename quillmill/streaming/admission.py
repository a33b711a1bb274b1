"""Incremental admission: the batch keys of ``operators.admission`` over a stream.

State is bounded by the watermark: a record is a duplicate if its content key or its address key
came within ``delay`` of it. Order within a micro-batch is the engine's, as ever in streams; the
batch operator is the one with a fixed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.admission import validation_reasons
from quillmill.operators.urls import url_key


def admitted(stream: DataFrame, text: str, url: str, ts: str, delay: str = "7 days", low: int = 300, high: int = 50000) -> DataFrame:
    """Valid records of a stream, each content and each address once within the watermark."""
    valid = stream.filter(F.size(validation_reasons(F.col(text), low, high)) == 0)
    keyed = valid.withColumn("content_key", F.md5(F.col(text))).withColumn("address_key", F.coalesce(url_key(F.col(url)), F.col("content_key")))
    by_content = keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_key"])
    return by_content.dropDuplicatesWithinWatermark(["address_key"])


def windowed_counts(stream: DataFrame, group: str, ts: str, width: str, slide: str, delay: str) -> DataFrame:
    """Rows per group in sliding windows, late rows up to the watermark included."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), group).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), group, "rows")
