"""Rows rendered as text (M1-M7, H1-H5, H7, H8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.lexicons import SUMMARY_ENDINGS


def numbered(items: Column) -> Column:
    """M1: "1. a" lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def bullets(items: Column) -> Column:
    """H12: "- a" lines, N/A without items."""
    return F.coalesce(F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")), F.lit("N/A"))


def file_name(slot: Column, day: Column, kind: Column, hour: Column) -> Column:
    """M5: 03_MON_REEL_8AM.md, TBD without a time."""
    h = F.when(hour.isNull(), "TBD").otherwise(F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.when(hour < 12, "AM").otherwise("PM")))
    return F.format_string("%02d_%s_%s_%s.md", slot, F.upper(F.left(day, F.lit(3))), F.upper(kind), h)


def preview(body: Column, limit: int = 150) -> Column:
    """M7: the first quotation of the body, else its beginning without mark-up."""
    quote = F.regexp_extract(body, r'(?m)^> "([^"]+)"', 1)
    plain = F.regexp_replace(body, r"[*_#>`]", "")
    return F.when(quote != "", quote).otherwise(F.left(F.trim(plain), F.lit(limit)))


def overview(rows: DataFrame, group: list[str], order: str, line: Column, out: str = "body") -> DataFrame:
    """M6: a document per group, one line per row in order. Groups are report sections, bounded by their slots."""
    return rows.select(*group, F.col(order).alias("__o"), line.alias("__line")).groupBy(*group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__line"))), lambda s: s["__line"]), "\n").alias(out)
    )


def _by_format(kind: Column, reel: Column, carousel: Column, quote: Column) -> Column:
    return F.coalesce(F.when(kind == "REEL", reel).when(kind == "CAROUSEL", carousel).when(kind == "QUOTE", quote), F.lit(""))


def full_text(kind: Column, reel: Column, slides: Column, quote: Column) -> Column:
    """H1: all text of a piece. ``reel``: struct hook_line, body (array), punch_line; ``slides``: array of struct
    headline, body; ``quote``: struct quote_text, quote_text_alt. Empty slide bodies are left out."""
    own = F.flatten(F.transform(slides, lambda s: F.array(s["headline"], F.when(s["body"] != "", s["body"]))))
    body = F.coalesce(F.array_join(reel["body"], " "), F.lit(""))
    return _by_format(
        kind,
        F.concat(reel["hook_line"], F.lit(" "), body, F.lit(" "), reel["punch_line"]),
        F.array_join(own, " "),
        F.concat(quote["quote_text"], F.lit(" "), F.coalesce(quote["quote_text_alt"], F.lit(""))),
    )


def first_line(kind: Column, reel: Column, slides: Column, quote: Column) -> Column:
    """H1: the hook, the first headline, or what comes before the quotation's first full stop."""
    return _by_format(kind, reel["hook_line"], F.get(slides, F.lit(0))["headline"], F.get(F.split(quote["quote_text"], r"\."), F.lit(0)))


def last_line(kind: Column, reel: Column, slides: Column, quote: Column) -> Column:
    """H1: the punch line, the last slide's body or else headline, or what follows the last full stop."""
    last = F.try_element_at(slides, F.lit(-1))
    stripped = F.regexp_replace(F.element_at(F.split(quote["quote_text"], r"\."), -1), r"^\s+|\s+$", "")
    return _by_format(kind, reel["punch_line"], F.when(last["body"] != "", last["body"]).otherwise(last["headline"]), stripped)


def summary_ending(last: Column, endings: tuple[str, ...] = SUMMARY_ENDINGS) -> Column:
    """H4: the first of the endings, in their order, that a last line contains; null without one."""
    return F.coalesce(*[F.when(F.contains(F.lower(last), F.lit(e)), F.lit(e)) for e in endings])


def length_failures(parts: Column, part_limit: int, least: int, most: int, total_limit: int) -> Column:
    """H1-H5: ordered reasons why a piece of several parts breaks its format's bounds; empty if it keeps them."""
    n = F.size(parts)
    over = F.filter(F.transform(parts, lambda p, i: F.when(F.length(p) > part_limit, F.concat(F.lit("part "), (i + 1).cast("string"), F.lit(" too long")))), lambda x: x.isNotNull())
    total = F.aggregate(F.transform(parts, F.length), F.lit(0), lambda a, x: a + x)
    semis = F.aggregate(F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit(";"), F.lit("")))), F.lit(0), lambda a, x: a + x)
    return F.concat(over, F.array_compact(F.array(F.when(n < least, "too few parts"), F.when(n > most, "too many parts"), F.when(total > total_limit, "too long"), F.when(semis > 0, "semicolons"))))


def piece_body(kind: Column, reel: Column, slides: Column, quote: Column, cover: str = "cover") -> Column:
    """M1: a piece as Markdown by its format: quoted hook, numbered lines and punch line; headed slides, the first
    marked as the cover; the quotation and its other form. Unknown formats have no body."""
    lines = F.transform(reel["body"], lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    slide = lambda s, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.when(i == 0, f" ({cover})").otherwise(""), F.lit("\n\n> **"), s["headline"], F.lit("**"), F.when(s["body"] != "", F.concat(F.lit("\n\n> "), s["body"])).otherwise(""))
    other = F.when(quote["quote_text_alt"] != "", F.concat(F.lit("\n\n> "), quote["quote_text_alt"])).otherwise("")
    return _by_format(
        kind,
        F.concat_ws("\n\n", F.concat(F.lit('> "'), reel["hook_line"], F.lit('"')), numbered(lines), F.concat(F.lit('> "'), reel["punch_line"], F.lit('"'))),
        F.array_join(F.transform(slides, slide), "\n\n"),
        F.concat(F.lit("> "), quote["quote_text"], other),
    )


def score_summary(rows: DataFrame, scores: str, criteria: list[tuple[str, int]], explain: list[str]) -> DataFrame:
    """H7, H8, M4: ``mean``, ``passed_all``, ``attention`` (the explained criteria that fail), ``error``.

    A missing score is 0; scores outside 1..10 make the row an error and leave the other columns null.
    """
    at = {n: F.coalesce(F.col(scores)[n], F.lit(0)) for n, _ in criteria}
    bad = F.array_join(F.array_compact(F.array(*[F.when(~v.between(1, 10), F.lit(n)) for n, v in at.items()])), ",")
    low = dict(criteria)
    passed = F.lit(True)
    for n, v in at.items():
        passed = passed & (v >= low[n])
    why = F.array_join(F.array_compact(F.array(*[F.when(at[n] < low[n], F.concat(F.lit(f"{n}: "), at[n].cast("string"), F.lit("/10"))) for n in explain])), ", ")
    fine = F.col("error").isNull()
    total = sum(at.values(), F.lit(0))
    return (
        rows.withColumn("error", F.when(bad != "", F.concat(F.lit("out of range: "), bad)))
        .withColumn("mean", F.when(fine, total / len(criteria))).withColumn("passed_all", F.when(fine, passed)).withColumn("attention", F.when(fine, why))
    )


def split_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ", "), lambda x: x != "")


BADGES = {"APPROVED": "approved", "FLAGGED": "to review", "REJECTED": "rejected"}


def header(kind: Column, number: Column, status: Column, flags: Column) -> Column:
    """M2: heading, badge and the reasons of a flag."""
    badge = F.coalesce(F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv])[status], F.concat(F.lit("? "), status))
    why = F.when((status == "FLAGGED") & (F.size(flags) > 0), F.concat(F.lit("\n\n"), F.array_join(F.transform(flags, lambda x: F.concat(F.lit("> - "), x)), "\n"))).otherwise("")
    return F.concat(F.lit("# "), kind, F.lit(" #"), number.cast("string"), F.lit("\n\n**Status:** "), badge, why)


def score_table(scores: str, criteria: list[tuple[str, int]]) -> Column:
    """M2: a row a criterion with its mark."""
    rows = [F.concat(F.lit(f"| {n} | "), F.coalesce(F.col(scores)[n], F.lit(0)).cast("string"), F.lit("/10 | "), F.when(F.coalesce(F.col(scores)[n], F.lit(0)) >= least, "ok").otherwise("low"), F.lit(" |")) for n, least in criteria]
    return F.concat(F.lit("| criterion | score | |\n|-|-|-|\n"), F.concat_ws("\n", *rows))


def footer(fields: list[tuple[str, Column]]) -> Column:
    """M2: names and ids, N/A where there is none."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: `"), F.coalesce(v, F.lit("N/A")), F.lit("`")) for n, v in fields])


def brief(sections: list[Column]) -> Column:
    """M3: the sections that are there, one after the other."""
    return F.concat_ws("\n\n---\n\n", *sections)
