"""Semi-structured text sources, configuration and state files, and the Markdown sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import stripped, word_count
from quillmill.operators.cleaning import clean_article
from quillmill.operators.urls import url_key
from quillmill.runtime import ship

ship(__name__)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of every file, each as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def text_blocks(files: DataFrame, value: str = "value", least_words: int = 50) -> DataFrame:
    """Blocks between dashed lines; a ``URL:`` header each, the rest cleaned and long enough."""
    header = r"(?imd)^URL\s*:\s*(.+)$"
    b = files.select(F.explode_outer(F.split(F.col(value), r"\n-{3,}\n")).alias("b")).select(stripped(F.col("b")).alias("b"))
    url = stripped(F.regexp_extract("b", header, 1))
    url = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    out = b.filter(F.col("b").rlike(header)).select(url.alias("url"), clean_article(F.regexp_replace("b", header, "")).alias("content"))
    return out.filter(word_count(F.col("content")) >= least_words).withColumn("url_key", url_key(F.col("url")))


def archives(files: DataFrame, value: str = "value") -> DataFrame:
    """``KEY: value`` lines, a line of dashes, the content; ``valid`` where URL, TITLE and AUTHOR_ID are there."""
    parts = F.split(F.col(value), r"\n---\n", 2)
    head = F.get(parts, F.lit(0))

    def key(name: str) -> Column:
        v = F.trim(F.regexp_extract(head, rf"(?md)^{name}:[ \t]*(.*)$", 1))
        return F.when(v != "", v)

    return files.select(*files.columns, key("URL").alias("url"), key("TITLE").alias("title"), key("AUTHOR_ID").alias("author_id"), stripped(F.get(parts, F.lit(1))).alias("content")).withColumn(
        "valid", F.col("url").isNotNull() & F.col("title").isNotNull() & F.col("author_id").isNotNull() & F.col("content").isNotNull()
    )


def write_bodies(df: DataFrame, path: str, name: str, body: str) -> int:
    """One file per row, named as it says, below ``path`` (any file system pyarrow knows); returns their number.

    Written where the rows are; a file appears whole, by a rename, so a task that is tried again does no harm.
    """
    schema = "written bigint"
    out = df.select(F.col(name).alias("name"), F.col(body).alias("body")).mapInPandas(_writer(path), schema)
    return out.agg(F.coalesce(F.sum("written"), F.lit(0)).alias("n")).first().n


def _writer(path: str):
    def run(batches):
        import posixpath
        import uuid

        import pandas as pd
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        done = 0
        for pdf in batches:
            for name, body in zip(pdf["name"], pdf["body"]):
                target = posixpath.join(root, name)
                where.create_dir(posixpath.dirname(target), recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}.part"
                with where.open_output_stream(draft) as f:
                    f.write((body or "").encode())
                where.move(draft, target)
                done += 1
        yield pd.DataFrame({"written": [done]})

    return run


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state kept as JSON (an array of records or one record a file); a missing file is an empty state."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_json_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def yaml_list(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The records under a key of a YAML configuration file; fields that a record lacks are null."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = (yaml.safe_load(f) or {}).get(key) or []
    names = T._parse_datatype_string(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def valid_files(files: DataFrame, suffix: str = ".pdf", path: str = "path", size: str = "length", start: str | None = "content", magic: bytes = b"%PDF") -> DataFrame:
    """``reason`` why a file (of Spark's binaryFile source) can't be read as its kind, null if it can."""
    named = F.lower(F.col(path)).endswith(suffix)
    head = F.lit(True) if start is None else F.coalesce(F.substring(F.col(start), 1, len(magic)) == F.lit(magic), F.lit(False))
    return files.withColumn("reason", F.when(F.col(path).isNull() | (F.col(size) == 0), "missing or empty").when(~named, f"not {suffix}").when(~head, "not of its kind"))
