"""Contracts for model-based enrichment (X1, X2, L20) and what surrounds them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.runtime import ship

ship(__name__)


def backoff(attempt: int, base: float = 2.0, most: float = 60.0, jitter: float = 0.0) -> float:
    """Seconds to wait after the attempt-th failure (0-based)."""
    return min(base * 2**attempt + jitter, most)


def retry_after(message: Column) -> Column:
    """Seconds a service asks to wait ("try again in 2.5s" or "500ms"), half a second on top; null if it doesn't say."""
    s = F.regexp_extract(message, r"try again in (\d+(?:\.\d+)?)s", 1)
    ms = F.regexp_extract(message, r"try again in (\d+)ms", 1)
    return F.when(s != "", s.cast("double") + 0.5).when(ms != "", ms.cast("double") / 1000 + 0.5)


def enriched(rows: DataFrame, columns: list[str], model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, attempts: int = 5, wait: float = 0.0) -> DataFrame:
    """Rows of ``columns`` through a model, batch by batch, with ``error`` instead of failing.

    The model gets a frame of a batch and returns as many rows of ``schema``. A batch that fails
    ``attempts`` times is tried row by row, so one bad row costs itself only.
    """
    out = T.StructType([*(rows.schema[c] for c in columns), *T._parse_datatype_string(schema).fields, T.StructField("error", T.StringType())])
    names = T._parse_datatype_string(schema).names

    def tried(pdf: pd.DataFrame) -> pd.DataFrame:
        why = ""
        for k in range(attempts):
            try:
                got = model(pdf).reset_index(drop=True)
                return pd.concat([pdf.reset_index(drop=True), got[names]], axis=1).assign(error=None)
            except Exception as e:  # noqa: BLE001
                why = f"{type(e).__name__}: {e}"
                if wait:
                    time.sleep(backoff(k, wait))
        if len(pdf) == 1:
            return pdf.reset_index(drop=True).assign(**{n: None for n in names}, error=why)
        return pd.concat([tried(pdf.iloc[[i]]) for i in range(len(pdf))], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield tried(pdf)

    return rows.select(*columns).mapInPandas(run, out)
