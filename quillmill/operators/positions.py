"""Exact positions of rows within their groups, however large a group is.

A global range-partitioned sort on (group, order) spreads every group over as many partitions as
it needs. Each partition numbers its rows locally and counts its groups in one streaming pass;
prefix sums of the counts over the partitions turn local numbers into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.runtime import ship, staged

ship(__name__)

LOCAL, COUNT, PART = "__local", "__count", "__part"


def _codes(batch: pa.RecordBatch, groups: list[str], names: list[str]) -> np.ndarray:
    """True where a row's group differs from the row before; the first row is False."""
    new = np.zeros(batch.num_rows, bool)
    for g in groups:
        col = batch.column(names.index(g))
        code = pc.fill_null(pc.dictionary_encode(col).indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _numberer(groups: list[str], names: list[str], keep: int | None, out_schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_key: tuple | None = None
        seen = 0

        def summary(keys: list[tuple], counts: list[int]) -> pa.RecordBatch:
            cols = []
            for f in out_schema:
                if f.name in groups:
                    i = groups.index(f.name)
                    cols.append(pa.array([k[i] for k in keys], f.type))
                elif f.name == LOCAL:
                    cols.append(pa.nulls(len(keys), f.type))
                elif f.name == COUNT:
                    cols.append(pa.array(counts, f.type))
                elif f.name == PART:
                    cols.append(pa.array([part] * len(keys), f.type))
                else:
                    cols.append(pa.nulls(len(keys), f.type))
            return pa.RecordBatch.from_arrays(cols, schema=out_schema)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _codes(batch, groups, names)

            def key_at(i: int, batch=batch) -> tuple:
                return tuple(batch.column(names.index(g))[i].as_py() for g in groups)

            first = key_at(0)
            closed: list[tuple] = []
            counts: list[int] = []
            if open_key is not None and first != open_key:
                closed.append(open_key)
                counts.append(seen)
                seen = 0
            starts = np.flatnonzero(new)
            bounds = np.concatenate([[0], starts])
            run_no = np.cumsum(new)
            local = np.arange(n) - bounds[run_no] + np.where(run_no == 0, seen, 0) + 1
            for i, b in enumerate(starts):
                closed.append(key_at(int(b) - 1))
                counts.append(int(local[b - 1]))
            open_key, seen = key_at(n - 1), int(local[-1])
            mask = np.ones(n, bool) if keep is None else local <= keep
            if mask.any():
                cols = [c.filter(pa.array(mask)) for c in batch.columns]
                m = int(mask.sum())
                cols += [pa.array(local[mask], pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.full(m, part, np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
            if closed:
                yield summary(closed, counts)
        if open_key is not None:
            yield summary([open_key], [seen])

    return run


def _numbered(df: DataFrame, groups: list[str], order: list[Column], keep: int | None, partitions: int | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [F.col(g).asc() for g in groups] + order
    by = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in df.schema]
        + [T.StructField(LOCAL, T.LongType()), T.StructField(COUNT, T.LongType()), T.StructField(PART, T.IntegerType())]
    )
    run = _numberer(groups, df.columns, keep, to_arrow_schema(schema))
    return by.sortWithinPartitions(*keys).mapInArrow(run, schema)


def first_positions(df: DataFrame, groups: list[str], order: list[Column], keep: int, position: str = "position", partitions: int | None = None) -> DataFrame:
    """Rows at positions 1..keep of each group, with their exact position.

    ``order`` must make every row of a group distinct. A local number never exceeds the true
    position, so a partition hands on at most ``keep`` rows and one count per group: what is
    shuffled for the prefix sums is bounded by groups and partitions, not by rows.
    """
    out = _numbered(df, groups, order, keep, partitions)
    before = Window.partitionBy(*groups).orderBy(F.col(PART), F.col(LOCAL).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        out.withColumn("__before", F.coalesce(F.sum(COUNT).over(before), F.lit(0)))
        .filter(F.col(LOCAL).isNotNull())
        .withColumn(position, F.col(LOCAL) + F.col("__before"))
        .filter(F.col(position) <= keep)
        .drop(LOCAL, COUNT, PART, "__before")
    )


def all_positions(df: DataFrame, groups: list[str], order: list[Column], position: str = "position", partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with exact positions, counts per group). The numbered rows are staged once."""
    out = staged(_numbered(df, groups, order, None, partitions), "positions")
    counts = out.filter(F.col(COUNT).isNotNull()).select(*groups, F.col(PART).alias("__p"), F.col(COUNT).alias("__n"))
    w = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    rows = out.filter(F.col(LOCAL).isNotNull()).drop(COUNT)
    on = F.lit(True)
    offs = offsets.select(*[F.col(g).alias(f"__o_{g}") for g in groups], "__p", "__before")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    placed = rows.join(offs, on & (F.col(PART) == F.col("__p"))).withColumn(position, F.col(LOCAL) + F.col("__before"))
    placed = placed.drop("__p", "__before", LOCAL, PART, *[f"__o_{g}" for g in groups])
    return placed, counts.groupBy(*groups).agg(F.sum("__n").alias("n"))
