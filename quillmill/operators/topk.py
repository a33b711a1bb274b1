"""Quotas, ratios and ranked picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_n(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n per group before the shuffle (WindowGroupLimit)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def two_tier(primary: DataFrame, secondary: DataFrame, group: str, order: list[Column], limit: int, least: int) -> DataFrame:
    """The primary candidates; where there are fewer than ``least``, secondary ones up to ``limit``."""
    a = best_n(primary, [group], order, limit).withColumn("tier", F.lit(1))
    b = best_n(secondary, [group], order, limit).withColumn("tier", F.lit(2))
    n = a.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    b = b.join(n, group, "left").filter((F.coalesce("__n", F.lit(0)) < least) & (F.col("rank") <= limit - F.coalesce("__n", F.lit(0)))).drop("__n")
    return a.unionByName(b)


def quota_sample(rows: DataFrame, group: str, key: str, quotas: dict[str, int]) -> DataFrame:
    """Per group its quota of rows, in the order of their keys' hashes (the same on every run)."""
    if not quotas:
        return rows.limit(0).withColumn("rank", F.lit(0))
    q = F.coalesce(F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])[F.col(group)], F.lit(0))
    # the largest quota is a literal, so that no more rows of a group are kept before the shuffle
    most = max(quotas.values(), default=0)
    return best_n(rows.filter(q > 0), [group], [F.md5(F.col(key).cast("string")), F.col(key)], most).filter(F.col("rank") <= q)


def scaled_quotas(quotas: dict[str, int], total: int) -> dict[str, int]:
    """Quotas scaled to a total, each at least one (so their sum may exceed it)."""
    base = sum(quotas.values())
    return {k: max(1, v * total // base) for k, v in quotas.items()}


def ratio_quotas(ratios: dict[str, float], limit: int) -> dict[str, int]:
    """W6's allocation: floors of the normalised ratios, the rest round robin from the largest ratio on."""
    total = sum(ratios.values())
    if total <= 0:
        return {}
    norm = {k: v / total for k, v in ratios.items()}
    out = {k: int(limit * v) for k, v in norm.items()}
    order = sorted(norm, key=lambda k: -norm[k])
    for i in range(limit - sum(out.values())):
        out[order[i % len(order)]] += 1
    return out


def ratio_allocation(rows: DataFrame, group: str, order: list[Column], ratios: dict[str, float], limit: int) -> DataFrame:
    """Per group its share, in order; what groups can't fill is filled from all others, in order."""
    quotas = ratio_quotas(ratios, limit)
    flat = [x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]
    q = F.coalesce(F.create_map(*flat)[F.col(group)], F.lit(0)) if flat else F.lit(0)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    near = ranked.filter(F.col("rank") <= limit).withColumn("own", F.col("rank") <= q)  # `limit` per group can ever be taken
    first = near.filter("own")
    rest = near.filter("not own").orderBy(*order).limit(limit)
    # at most `limit` rows of either kind: own ones first, then the others in order
    both = first.unionByName(rest).withColumn("__r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("own"), *order)))
    return both.filter(F.col("__r") <= limit).drop("__r").withColumn("backfill", ~F.col("own")).drop("own", "rank")


def arg_max(rows: DataFrame, group: list[str], score: str, ties: list[Column]) -> DataFrame:
    """The row of the highest score; the first of equal ones."""
    return best_n(rows, group, [F.desc(score), *ties], 1).drop("rank")
