"""Filters, joins, aggregates and set operations over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_all(arr: Column, needles: list[str]) -> Column:
    """array containment."""
    return F.size(F.array_except(F.array(*map(F.lit, needles)), arr)) == 0


def status_counts(rows: DataFrame, column: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Rows per value, null as ``unknown``."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(unknown)).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def window_counts(events: DataFrame, group: str, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows per group within [as_of - days, as_of]."""
    end = F.lit(as_of).cast("timestamp")
    inside = F.col(ts).between(end - F.expr(f"interval {int(days)} days"), end)
    return events.filter(inside).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))


def evenness(counts: DataFrame, rows: str, groups: int) -> DataFrame:
    """Shannon entropy over the logarithm of the number of possible groups; 1 where there are no rows.

    With T rows in all it is log2 T - sum(n log2 n) / T, so one pass does without the shares.
    """
    n = F.col(rows).cast("double")
    total = F.sum(n)
    entropy = F.log2(total) - F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0)) / total
    return counts.agg(F.when(total > 0, entropy / F.log2(F.lit(float(groups)))).otherwise(F.lit(1.0)).alias("evenness"))


def _with_total(counts: DataFrame, *aggs: Column) -> DataFrame:
    """Every row beside aggregates of all rows (one row, joined on a constant)."""
    one = counts.agg(*aggs).withColumn("__one", F.lit(1))
    return counts.withColumn("__one", F.lit(1)).join(one, "__one").drop("__one")


def shares(counts: DataFrame, rows: str, limit: float) -> DataFrame:
    """Every group's share, and whether it is saturated."""
    j = _with_total(counts, F.sum(rows).alias("__t"))
    return j.withColumn("share", F.col(rows) / F.col("__t")).withColumn("saturated", F.col("share") > limit).drop("__t")


def underused(groups: DataFrame, group: str, counts: DataFrame, rows: str, factor: float = 0.8) -> DataFrame:
    """Groups, absent ones included, with less than ``factor`` of an even share; all if there are no rows."""
    j = groups.select(group).distinct().join(counts, group, "left").withColumn(rows, F.coalesce(rows, F.lit(0)))
    t = _with_total(j, F.sum(rows).alias("__t"), F.count(F.lit(1)).alias("__n"))
    return t.filter((F.col(rows) < F.col("__t") / F.col("__n") * factor) | (F.col("__t") == 0)).drop("__t", "__n")


def unused_since(rows: DataFrame, usage: DataFrame, keys: list[str], ts: str, as_of: str, days: int) -> DataFrame:
    """Rows whose key (or pair of keys) wasn't used within the window; null keys in usage block nothing."""
    end = F.lit(as_of).cast("timestamp")
    recent = usage.filter(F.col(ts).between(end - F.expr(f"interval {int(days)} days"), end)).select(*keys).dropna().distinct()
    return rows.join(recent, keys, "left_anti")


def free_angles(angles: DataFrame, fits: Column, key: str, usage: DataFrame, atom: str, value: object, ts: str, as_of: str, days: int) -> DataFrame:
    """Active angles that fit, or all if none does, without those used with one atom in the window."""
    pool = _with_total(angles, F.max(F.coalesce(fits, F.lit(False))).alias("__any")).filter(fits | ~F.col("__any")).drop("__any")
    return unused_since(pool, usage.filter(F.col(atom) == F.lit(value)), [key], ts, as_of, days)


def week_rows(rows: DataFrame, day: str, year: int, week: int) -> DataFrame:
    """rows of an ISO week, as a range of days that reaches the scan."""
    from datetime import date, timedelta

    monday = date.fromisocalendar(year, week, 1)
    return rows.filter((F.col(day) >= F.lit(monday)) & (F.col(day) < F.lit(monday + timedelta(days=7))))


def exists_any(rows: DataFrame) -> DataFrame:
    """F16: one row that tells whether there are rows."""
    return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))


def looked_up(keys: DataFrame, key: str, table: DataFrame, on: str) -> DataFrame:
    """rows by their keys; ``found`` is false where there is none."""
    hit = table.withColumn("__hit", F.lit(True)).withColumnRenamed(on, "__on")
    return keys.join(hit, F.col(key) == F.col("__on"), "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit", "__on")


def within_lookback(epoch: Column, as_of: str, days: int) -> Column:
    """seconds since 1970 of at most so many days before ``as_of``; null and 0 never are."""
    return F.coalesce((epoch != 0) & (F.timestamp_seconds(epoch) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")), F.lit(False))


def with_brief(content: DataFrame, schedules: DataFrame) -> DataFrame:
    """Pieces beside their schedule and its brief, {} where it has none; pieces without a schedule drop out."""
    s = schedules.select(F.col("id").alias("schedule_id"), "trace_id", "required_pillar", "required_format", F.coalesce("brief", F.lit("{}")).alias("brief"))
    return content.select(F.col("id").alias("generated_content_id"), "schedule_id").join(s, "schedule_id")


def rekeyed(rows: DataFrame, key: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Keys replaced where the mapping has them, else as they are."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return rows.join(m, F.col(key) == F.col("__old"), "left").withColumn(key, F.coalesce("__new", key)).drop("__old", "__new")


def base_title(title: Column) -> Column:
    """A title bare of a part suffix."""
    return F.regexp_replace(title, r"\s*\(Part \d+/\d+\)$", "")


def title_known(rows: DataFrame, title: str, group: str, existing: DataFrame) -> DataFrame:
    """``known`` tells whether a title, bare of a part suffix, begins one that its group has.

    Existing titles are looked up by those of their beginnings that are as long as some base title of
    their group: an equi-join, so neither pairs nor a whole group meet in one task.
    """
    new = rows.withColumn("__t", base_title(F.col(title)))
    sizes = new.filter(F.col(group).isNotNull() & F.col("__t").isNotNull()).select(F.col(group).alias("__g"), F.length("__t").alias("__n")).distinct()
    sizes = sizes.groupBy("__g").agg(F.collect_set("__n").alias("__ns"))  # no more than a title is long
    old = existing.select(F.col(group).alias("__g"), F.col(title).alias("__x")).filter("__g is not null and __x is not null").distinct().join(sizes, "__g")
    begins = old.select("__g", "__x", F.explode("__ns").alias("__n")).filter("__n <= length(__x)").select("__g", F.expr("left(__x, __n)").alias("__b")).distinct()
    out = new.join(begins, (F.col(group) == F.col("__g")) & (F.col("__t") == F.col("__b")), "left")
    return out.select(*[rows[c] for c in rows.columns], F.col("__b").isNotNull().alias("known"))


def merged(kept: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """All kept rows, and the added ones whose key is new."""
    return kept.unionByName(added.join(kept.select(key), key, "left_anti").select(*kept.columns))
