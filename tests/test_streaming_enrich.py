"""Streams in memory and the enrichment contract."""

import pandas as pd
from pyspark.sql import functions as F

from quillmill.operators.enrich import backoff, enriched, retry_after
from quillmill.streaming.admission import admitted, windowed_counts


def run(spark, tmp_path, df, make, name):
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_admission_over_a_stream(spark, tmp_path):
    long_ = "x" * 300
    rows = [(1, long_, "https://a/x", 0), (2, long_, "https://a/y", 1), (3, long_ + "b", "https://a/x/", 2), (4, long_ + "c", None, 3), (5, "short", "https://a/z", 4), (6, "[removed]", "https://a/w", 5)]
    df = spark.createDataFrame(rows, "id int, t string, u string, s int").select("id", "t", "u", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")).coalesce(1)
    got = run(spark, tmp_path, df, lambda s: admitted(s, "t", "u", "ts"), "admitted_rows")
    assert len(got) == 2 and {x.id for x in got} <= {1, 2, 3, 4} and 4 in {x.id for x in got}


def test_windowed_counts_over_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 30), ("b", 70), ("a", 100_000)], "g string, s int").select("g", F.timestamp_seconds(F.col("s")).alias("ts")).coalesce(1)
    got = run(spark, tmp_path, df, lambda s: windowed_counts(s, "g", "ts", "1 minute", "1 minute", "1 minute"), "window_rows")
    assert {(x.g, x.rows) for x in got if x.start.year == 1970 and x.start.day == 1} >= {("a", 2), ("b", 1)}


def test_enrichment_keeps_errors_to_their_rows(spark):
    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf.t == "bad").any():
            raise ValueError("no")
        return pd.DataFrame({"n": pdf.t.str.len()})

    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "de")], "id int, t string").coalesce(1)
    got = {x.id: (x.n, x.error) for x in enriched(df, ["id", "t"], model, "n int", attempts=2).collect()}
    assert got == {1: (3, None), 2: (None, "ValueError: no"), 3: (2, None)}
    assert enriched(df.limit(0), ["id", "t"], model, "n int").count() == 0


def test_waits(spark):
    assert [backoff(k) for k in range(6)] == [2, 4, 8, 16, 32, 60]
    m = spark.createDataFrame([("please try again in 2.5s",), ("try again in 500ms",), ("no",)], "m string").select(retry_after(F.col("m"))).collect()
    assert [x[0] for x in m] == [3.0, 1.0, None]
