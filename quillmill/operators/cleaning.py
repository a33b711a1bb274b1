"""Document structure cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import lexicons as L
from quillmill.functions.text import any_of, joined, lines, stripped, words


def fix_encoding(text: Column, pairs: list[tuple[str, str]] = L.ENCODING) -> Column:
    """Single characters by one translate, longer results by replace."""
    single = [(a, b) for a, b in pairs if len(b) == 1]
    gone = [a for a, b in pairs if not b]
    out = F.translate(text, "".join(a for a, _ in single) + "".join(gone), "".join(b for _, b in single))
    for a, b in pairs:
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def drop_page_numbers(text: Column, patterns: list[str] = L.PAGE_NUMBER_LINES) -> Column:
    """Lines that are nothing but a page number, in any of the patterns' forms."""
    whole = "(?i)^(?:" + any_of(patterns) + ")$"
    return joined(F.filter(lines(text), lambda x: ~x.rlike(whole)))


def drop_repeated_lines(docs: DataFrame, id_col: str, text: str, min_lines: int = 50, min_count: int = 3, out: str = "cleaned") -> DataFrame:
    """Lines that recur in a document (short ones, without regard to case) are running heads.

    Counted inside the row: no shuffle, and a long document costs its own length only.
    """
    arr = lines(F.col(text))
    norm = F.transform(arr, lambda x: F.lower(stripped(x)))
    able = F.filter(norm, lambda x: (F.length(x) > 3) & (F.length(x) < 100) & (F.size(words(x)) < 10))
    # sorted, a value that equals its neighbour min_count - 1 places on occurs min_count times
    ranked = docs.withColumn("__s", F.array_sort(able)).withColumn("__n", F.size(arr))
    often = F.array_distinct(F.filter("__s", lambda x, i: F.get("__s", i + (min_count - 1)) == x))
    ranked = ranked.withColumn("__often", often)
    kept = joined(F.filter(arr, lambda x: ~F.array_contains("__often", F.lower(stripped(x)))))
    return ranked.withColumn(out, F.when(F.col("__n") < min_lines, F.col(text)).otherwise(kept)).drop("__s", "__n", "__often")


def drop_contents(text: Column, start: list[str] = L.TOC_START, entry: str = L.TOC_LINE, patience: int = 5) -> Column:
    """T4: a table of contents, as a fold over the lines that carries a flag for each.

    After a heading, entries reset the count and go; other lines count and go too, until the
    ``patience``-th ends the table and stays.
    """
    arr = lines(text)
    is_start = "^(?:" + any_of(start) + ")$"
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("strange"), F.array().cast("array<boolean>").alias("keep"))

    def step(s: Column, x: Column) -> Column:
        begins = F.lower(stripped(x)).rlike(is_start)
        entry_line = x.rlike("^" + entry + "$")
        blank = stripped(x) == ""
        count = F.when(begins | entry_line, 0).when(blank, s["strange"]).otherwise(s["strange"] + 1)
        ends = s["inside"] & ~begins & ~entry_line & ~blank & (count >= patience)
        keep = ~begins & (~s["inside"] | ends)
        return F.struct(
            F.when(begins, True).when(ends, False).otherwise(s["inside"]).alias("inside"),
            F.when(begins | s["inside"], count).otherwise(s["strange"]).cast("int").alias("strange"),
            F.concat(s["keep"], F.array(keep)).alias("keep"),
        )

    flags = F.aggregate(arr, zero, step, lambda s: s["keep"])
    pairs = F.filter(F.arrays_zip(arr.alias("line"), flags.alias("keep")), lambda x: x["keep"])
    return joined(F.transform(pairs, lambda x: x["line"]))


def _first(arr: Column, test, low: Column, high: Column) -> Column:
    """Lowest 0-based index within [low, high) whose element passes, or null."""
    hits = F.filter(F.transform(arr, lambda x, i: F.when((i >= low) & (i < high) & test(x), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def cut_acknowledgments(text: Column, min_lines: int = 30, share: float = 0.15, reach: int = 50) -> Column:
    """T5: from a heading near the top to the next chapter, or the heading alone."""
    arr = lines(text)
    n = F.size(arr)
    head = "^(?:" + any_of(L.ACKNOWLEDGMENTS) + ")$"
    start = _first(arr, lambda x: F.lower(stripped(x)).rlike(head), F.lit(0), F.floor(n * F.lit(share)).cast("int"))
    chapter = any_of(L.FRONT_CHAPTERS)
    end = _first(arr, lambda x: F.lower(stripped(x)).rlike(chapter), start + 1, F.least(start + reach, n))
    cut = F.coalesce(end, start + 1)
    rest = joined(F.concat(F.slice(arr, F.lit(1), start), F.slice(arr, cut + 1, F.greatest(n - cut, F.lit(0)))))
    return F.when((n < min_lines) | start.isNull(), text).otherwise(rest)


def cut_back_matter(text: Column, min_lines: int = 100, share: float = 0.85) -> Column:
    """Everything from the first index or bibliography heading in the last part on."""
    arr = lines(text)
    n = F.size(arr)
    head = "^(?:" + any_of(L.BACK_MATTER) + ")$"
    at = _first(arr, lambda x: F.lower(stripped(x)).rlike(head), F.floor(n * F.lit(share)).cast("int"), n)
    return F.when((n < min_lines) | at.isNull(), text).otherwise(joined(F.slice(arr, F.lit(1), at)))


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks as one, line ends bare, two line feeds at most."""
    one = F.regexp_replace(text, r"(?U)[\s&&[^\n]]+", " ")
    return F.regexp_replace(F.regexp_replace(one, r" +(?=\n|\z)", ""), r"\n{3,}", "\n\n")


def cleaned(docs: DataFrame, id_col: str, text: str, pages: str | None = None, most_removed: float = 0.3) -> DataFrame:
    """T1-T8 in order: ``cleaned``, ``removed`` (characters per step), ``removed_share``, ``cleaning_warnings``."""
    p = F.col(pages) if pages else F.lit(1)
    df = docs.withColumn("s0", F.col(text)).withColumn("s1", fix_encoding(F.col("s0"))).withColumn("s2", drop_page_numbers(F.col("s1")))
    df = drop_repeated_lines(df, id_col, "s2", out="s3")
    df = df.withColumn("s4", F.when(p >= 10, drop_contents(F.col("s3"))).otherwise(F.col("s3")))
    df = df.withColumn("s5", cut_acknowledgments(F.col("s4")))
    df = df.withColumn("s6", F.when(p >= 20, cut_back_matter(F.col("s5"))).otherwise(F.col("s5")))
    df = df.withColumn("s7", collapse_blanks(F.col("s6")))
    names = ["encoding", "page_numbers", "headers_footers", "toc", "acknowledgments", "back_matter", "whitespace"]
    pairs = [x for k, n in enumerate(names) for x in (F.lit(n), F.length(f"s{k}") - F.length(f"s{k + 1}"))]
    removed = F.map_filter(F.create_map(*pairs), lambda _, v: v > 0)
    final = stripped(F.col("s7"))
    share = F.when(F.length("s0") > 0, (F.length("s0") - F.length("cleaned")) / F.length("s0")).otherwise(F.lit(0.0))
    df = df.withColumn("cleaned", final).withColumn("removed", removed).withColumn("removed_share", share)
    told = F.format_string(f"High removal rate: %.1f%% of text removed (threshold: {most_removed:.0%}%)", F.col("removed_share") * 100)
    warnings = F.array_compact(F.array(F.when(F.col("removed_share") > most_removed, told)))
    return df.withColumn("cleaning_warnings", warnings).drop(*[f"s{k}" for k in range(8)])


def confidence(removed_share: Column, chars: Column, pages: Column, warnings: Column) -> Column:
    """An extraction's confidence between 0 and 1."""
    loss = F.when(removed_share > 0.3, 0.30).when(removed_share > 0.2, 0.15).when(removed_share > 0.1, 0.05).otherwise(0.0)
    per_page = chars / F.greatest(pages, F.lit(1))
    thin = F.when(per_page < 100, 0.4).when(per_page < 500, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - loss - thin - F.lit(0.02) * warnings))


def clean_article(text: Column, junk: list[str] = L.ARTICLE_JUNK) -> Column:
    """Pasted articles; a junk pattern takes the rest of its line."""
    out = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " ")
    for p in junk:
        out = F.regexp_replace(out, "(?id)" + p.replace("|$)", r"|\z)"), "")
    return stripped(out)


def clean_transcript(text: Column, junk: list[str] = L.TRANSCRIPT_JUNK) -> Column:
    """Sound marks and lone time stamps."""
    out = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " ")
    for p in junk:
        out = F.regexp_replace(out, "(?imd)" + p, "")
    return stripped(out)
