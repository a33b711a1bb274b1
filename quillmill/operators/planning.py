"""Slots, angles and their assignment (F12-F14, J4, W10), reports and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.relational import evenness, shares, underused
from quillmill.operators.topk import best_n


def _angle_keys(angles: DataFrame, id_col: str = "angle") -> DataFrame:
    """Active angles, one row per pillar and format they fit. ``angles``: angle, active, pillars, formats, levels, multiplier."""
    a = angles.filter("active").select(id_col, "multiplier", F.when(F.size("levels") >= 2, F.col("levels")).alias("__l"), F.explode("pillars").alias("pillar"), "formats")
    return a.select(id_col, "multiplier", "pillar", F.explode("formats").alias("format"), F.get("__l", F.lit(0)).alias("__low"), F.get("__l", F.lit(1)).alias("__high")).distinct()


def compatible_angles(rows: DataFrame, angles: DataFrame, level: str, usual: int = 3) -> DataFrame:
    """rows (pillar, format, ``level``) beside every active angle that fits them, as an equi-join with a range test.

    An angle without two bounds takes any level; a null level counts as ``usual``.
    """
    at = F.coalesce(F.col(level), F.lit(usual))
    j = rows.join(_angle_keys(angles), ["pillar", "format"])
    return j.filter(F.col("__low").isNull() | at.between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def angles_of_format(angles: DataFrame, best: int | None = None) -> DataFrame:
    """active angles by format, the highest multiplier first; F13 with ``best``: the first of each."""
    a = angles.filter("active").select(F.explode("formats").alias("format"), "angle", "multiplier").distinct()
    if best is None:
        return a.orderBy("format", F.desc("multiplier"), "angle")
    return best_n(a, ["format"], [F.desc("multiplier"), F.col("angle")], best)


def slot_candidates(slots: DataFrame, items: DataFrame, angles: DataFrame, level: str, fallback: int = 5) -> DataFrame:
    """Slot x item x angle. ``slots``: slot, pillar, format; ``items``: item, pillar, formats, ``level``, more.

    The array containments are exploded into equi-joins; items no angle fits get the format's fallback angles.
    """
    one = items.withColumn("format", F.explode(F.array_distinct("formats"))).drop("formats")
    j = one.join(slots, ["pillar", "format"])
    fit = compatible_angles(j, angles, level).withColumn("fallback", F.lit(False))
    rest = j.join(fit.select("slot", "item").distinct(), ["slot", "item"], "left_anti")
    rest = rest.join(angles_of_format(angles, fallback).select("format", "angle", "multiplier"), "format").withColumn("fallback", F.lit(True))
    return fit.unionByName(rest)


def greedy_assignment(candidates: DataFrame, slots: int, slot: str = "slot", item: str = "item", score: str = "score", extra: str = "angle") -> DataFrame:
    """Slots in order, each takes its best item that none before it took (ties: the lower item, then ``extra``).

    At most ``slots`` - 1 items can be gone before a slot, so its ``slots`` best are enough; they are found per
    slot in parallel, and only those (``slots`` squared at most) meet in one ordered fold.
    """
    top = best_n(best_n(candidates, [slot, item], [F.desc(score), F.col(extra)], 1).drop("rank"), [slot], [F.desc(score), F.col(item)], slots)
    rows = top.agg(F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), "rank", F.col(item).alias("item"), F.col(score).alias("score"), F.col(extra).alias("extra")))).alias("c"))
    kind = rows.schema["c"].dataType.simpleString()
    zero = F.array().cast(kind)

    def step(taken: Column, x: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["slot"] == x["slot"]) | (t["item"] == x["item"]))
        return F.when(free, F.concat(taken, F.array(x))).otherwise(taken)

    out = rows.select(F.explode(F.aggregate("c", zero, step)).alias("p"))
    return out.select(F.col("p.slot").alias(slot), F.col("p.item").alias(item), F.col("p.score").alias(score), F.col("p.extra").alias(extra))


def diversity_report(rows: DataFrame, group: str, counts: DataFrame, n: str, groups: int, limit: float) -> DataFrame:
    """G9 in one row: evenness, and the underused and saturated groups in order."""
    names = lambda df, out: df.agg(F.array_join(F.array_sort(F.collect_set(group)), ",").alias(out))
    parts = [evenness(counts, n, groups), names(underused(rows, group, counts, n), "underused"), names(shares(counts, n, limit).filter("saturated"), "saturated")]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def utilisation(counts: DataFrame, group: str, n: str, rates: dict[str, float]) -> DataFrame:
    """The mean rate of all rows, weighted by the groups' counts; groups without a rate count as 0."""
    rate = F.coalesce(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col(group)], F.lit(0.0))
    total = F.sum(n)
    return counts.agg(F.when(total > 0, F.sum(F.col(n) * rate) / total).otherwise(F.lit(0.0)).alias("utilisation"))


def outcome_counts(rows: DataFrame, outcomes: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """How many rows met each outcome, and how many there were."""
    return rows.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(c).alias(k) for k, c in outcomes.items()])
