"""Deduplicating admission into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.positions import all_positions
from quillmill.operators.relational import base_title, title_known
from quillmill.runtime import staged


def first_by_content(rows: DataFrame, content: str, order: list[Column]) -> DataFrame:
    """D1 where the other key is unique: the first row of every content; null contents all stay."""
    # the least row of each content, combined before the shuffle; rows without content go past it
    some = rows.filter(F.col(content).isNotNull()).groupBy(F.md5(F.col(content)).alias("__c"))
    first = some.agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__r")).select("__r.*")
    return first.unionByName(rows.filter(F.col(content).isNull()))


def not_in_history(rows: DataFrame, history: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows none of whose keys (own column, history's column) occurs in the history; null keys never match."""
    out = rows
    for own, theirs in keys:
        known = history.select(F.col(theirs).alias("__k")).filter("__k is not null").distinct()
        out = out.join(known, F.col(own) == F.col("__k"), "left_anti")
    return out


def two_key_admission(rows: DataFrame, content: str, source: str, order: str) -> DataFrame:
    """D1 in general: rows in order; one is admitted unless its content or its source was admitted before.

    Only admitted rows block later ones. That greedy walk is found in parallel rounds: a row that is
    the first undecided one of its content and of its source is admitted, then all that share a key
    with an admitted row are out. No group is gathered, every round is a few aggregations, and each
    settles at least the first row of every conflict; null and empty sources conflict with nothing.
    """
    keyed = rows.select(F.col(order).alias("__o"), F.md5(F.col(content)).alias("__c"), F.when(F.col(source) != "", F.col(source)).alias("__s"))
    # of rows alike in both keys only the first can be admitted
    both = keyed.filter("__c is not null and __s is not null").groupBy("__c", "__s").agg(F.min("__o").alias("__o")).select("__o", "__c", "__s")
    left = staged(both.unionByName(keyed.filter("__c is null or __s is null")), "undecided")
    admitted: list[DataFrame] = []
    while not left.isEmpty():
        by_c = left.filter("__c is not null").groupBy(F.col("__c").alias("__kc")).agg(F.min("__o").alias("__mc"))
        by_s = left.filter("__s is not null").groupBy(F.col("__s").alias("__ks")).agg(F.min("__o").alias("__ms"))
        j = left.join(by_c, F.col("__c") == F.col("__kc"), "left").join(by_s, F.col("__s") == F.col("__ks"), "left")
        won = staged(j.filter("(__mc is null or __mc = __o) and (__ms is null or __ms = __o)").select("__o", "__c", "__s"), "admitted")
        admitted.append(won.select("__o"))
        left = left.join(won.select(F.col("__o").alias("__w")), F.col("__o") == F.col("__w"), "left_anti")
        left = left.join(won.select(F.col("__c").alias("__w")).filter("__w is not null"), F.col("__c") == F.col("__w"), "left_anti")
        left = staged(left.join(won.select(F.col("__s").alias("__w")).filter("__w is not null"), F.col("__s") == F.col("__w"), "left_anti"), "undecided")
    if not admitted:
        return rows.limit(0)
    every = admitted[0]
    for x in admitted[1:]:
        every = every.unionByName(x)
    return rows.join(every, F.col(order) == F.col("__o"), "left_semi")


def validation_reasons(text: Column, low: int = 300, high: int = 50000, removed: tuple[str, ...] = ("[removed]", "[deleted]"), extra: list[tuple[str, Column]] | None = None) -> Column:
    """every reason a record fails, in order; the length is tested only for real contents."""
    empty = text.isNull() | (text == "")
    gone = F.coalesce(text.isin(*removed), F.lit(False))
    sized = ~empty & ~gone
    tests = [("content_deleted", gone), ("content_empty", empty), ("content_too_short", sized & (F.length(text) < low)), ("content_too_long", sized & (F.length(text) > high)), *(extra or [])]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))


def rejection_records(rows: DataFrame, id_col: str, text: str, reasons: str, phase: str, snapshot: int = 200) -> DataFrame:
    """rejected rows as (id, phase, reasons JSON, snapshot JSON)."""
    return rows.filter(F.size(reasons) > 0).select(
        F.col(id_col).alias("id"), F.lit(phase).alias("phase"), F.to_json(reasons).alias("reasons"), F.to_json(F.struct(F.left(F.col(text), F.lit(snapshot)).alias("content"))).alias("snapshot")
    )


def next_index(new: DataFrame, existing: DataFrame, group: str, index: str, order: Column) -> DataFrame:
    """New rows numbered on from the group's highest index."""
    top = existing.groupBy(group).agg(F.max(index).alias("__top"))
    # numbered by a sort that splits large groups over tasks; ``order`` tells a group's rows apart
    placed, _ = all_positions(new, [group], [order], "__place")
    return placed.join(top, group, "left").withColumn("next_index", (F.coalesce("__top", F.lit(-1)) + F.col("__place")).cast("int")).drop("__top", "__place")


def resolved_slugs(rows: DataFrame, name: str, order: Column) -> DataFrame:
    """Slugs of names; the second and later of a slug get _1, _2 and so on."""
    placed, _ = all_positions(rows.withColumn("slug", slug(F.col(name))), ["slug"], [order], "__place")
    k = F.col("__place") - 1
    return placed.withColumn("unique_slug", F.when(k == 0, F.col("slug")).otherwise(F.concat_ws("_", "slug", k.cast("string")))).drop("__place")


def slug(name: Column, limit: int | None = None) -> Column:
    """Lower case, apostrophes dropped, anything else between ASCII letters and digits as one underscore."""
    bare = F.regexp_replace(F.lower(name), "['’`]", "")
    out = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "unknown").otherwise(F.left(out, F.lit(limit)) if limit else out)


def routed(files: DataFrame, key: str, order: str, tracked: DataFrame, authors: DataFrame, author: str, titles: DataFrame, title: str) -> DataFrame:
    """One outcome per file, tests in order: parse error, duplicate, unknown author, title known, inserted.

    Earlier rows of a run count as known: the second of a key in order is a duplicate, and a title, bare of
    a part suffix, is known if it begins one that its author has in ``titles`` or that was inserted before.
    """
    t = tracked.select(F.col(key).alias("__tk")).distinct()
    a = authors.select(F.col(author).alias("__ak")).distinct()
    j = files.join(t, F.col(key) == F.col("__tk"), "left").join(a, F.col(author) == F.col("__ak"), "left")
    bad = F.col(key).isNull() | F.col(title).isNull()
    firsts = files.filter(~bad).groupBy(F.col(key).alias("__fk")).agg(F.min(order).alias("__first"))
    j = j.withColumn("__bad", bad).join(firsts, F.col(key) == F.col("__fk"), "left").withColumn("__again", F.col(order) > F.col("__first"))
    early = F.when(F.col("__bad"), "parse_error").when(F.col("__tk").isNotNull() | F.col("__again"), "duplicate").when(F.col("__ak").isNull(), "unknown_author")
    j = staged(j.select(*files.columns, early.alias("__early")), "routed")
    new = title_known(j.filter("__early is null").select(order, author, title), title, author, titles).filter("not known")
    kept = inserted_titles(new, title, author, order).withColumnRenamed("__o", "__in")
    out = j.join(kept, F.col(order) == F.col("__in"), "left")
    outcome = F.coalesce("__early", F.when(F.col("__in").isNull(), "title_known").otherwise("inserted"))
    return out.withColumn("outcome", outcome).drop("__early", "__in")


def inserted_titles(rows: DataFrame, title: str, group: str, order: str) -> DataFrame:
    """``order`` of the rows, as ``__o``, whose base title begins no title of its group that was inserted before.

    Only inserted rows block later ones; as in two_key_admission that walk is found in rounds, each of
    which settles at least the first row left of every group. A title is looked up by those of its
    beginnings that are as long as some base of the group, so no pairs are formed.
    """
    left = staged(rows.select(F.col(order).alias("__o"), F.col(group).alias("__g"), F.col(title).alias("__t"), base_title(F.col(title)).alias("__b")), "titles")
    out = left.select("__o").limit(0)

    def first(by: DataFrame, of: DataFrame) -> DataFrame:
        """Rows of ``of`` beside the first row of ``by`` whose title their base begins."""
        lengths = of.groupBy("__g").agg(F.collect_set(F.length("__b")).alias("__l"))
        begins = by.join(lengths, "__g").select("__g", "__o", "__t", F.explode("__l").alias("__n")).filter("__n <= length(__t)")
        least = begins.groupBy("__g", F.expr("left(__t, __n)").alias("__b")).agg(F.min("__o").alias("__m"))
        return of.join(least, ["__g", "__b"], "left")

    while not left.isEmpty():
        won = staged(first(left, left).filter("__m = __o").select("__o", "__g", "__t"), "inserted")
        out = out.unionByName(won.select("__o"))
        rest = left.join(won.select("__o"), "__o", "left_anti")
        left = staged(first(won, rest).filter("__m is null or __m > __o").select("__o", "__g", "__t", "__b"), "titles")
    return out
