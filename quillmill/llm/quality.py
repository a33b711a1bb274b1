r"""Problem 7: per-document text statistics and a verdict, with a recorded reason per failure.

All statistics are built-in string expressions over the whole text, so they stay in the JVM.
Thresholds are published ones: of Gopher's rules (Rae et al. 2021) mean word length 3 to 10, at least 80 % of
words with a letter (words as runs of letters and digits), at most 0.1 hash signs and ellipses a word, at most 90 % of lines with a bullet, at least
two stop words; of FineWeb's (Penedo et al. 2024) at least 12 % of lines ending in punctuation and at most 67 %
in lines under 30 characters, here of the characters, and a text fails if it breaks both (verse breaks the second
alone, speech without punctuation the first). One rule is this project's own: under 12 % common words, which tells
garbled text and keyed data that have a letter in every word.

Defined results: null text gives null statistics and no verdict (never a case); empty and blank
texts have zero counts; texts under ``MIN_CHARS`` characters are never junk; mark-up tags count as
blanks; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common_words import all_words, trie_pattern

MIN_CHARS = 100
#: Gopher's thresholds, FineWeb's, and the project's own.
WORD_LENGTH, MIN_ALPHABETIC, MAX_SYMBOLS, MAX_BULLETS, MIN_STOPS = (3.0, 10.0), 0.8, 0.1, 0.9, 2
MIN_ENDED, MAX_SHORT, SHORT_LINE = 0.12, 0.67, 30
MIN_COMMON = 0.12

STATISTICS = frozenset("chars words lines mean_word_length common_share alphabetic_share symbol_ratio ended_share bullet_share short_share reasons junk".split())

TAG = r"<[^<>\n]++>"
#: A line of fewer than SHORT_LINE characters after the blanks at its start.
SHORT = rf"(?md)^[ \t\r]*+[^\n]{{1,{SHORT_LINE - 1}}}+$"


def with_statistics(items: DataFrame, text: str) -> DataFrame:
    """The rows with the statistics' columns, ``reasons`` and ``junk`` added; input columns of these names give way."""
    t = F.col(text)
    items = items.drop(*[c for c in items.columns if c.lower() in STATISTICS and c != text])
    df = items.withColumn("__plain", F.translate(F.regexp_replace(t, TAG, " "), "\xa0  　", "    "))
    df = df.withColumn("__flat", F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("__plain"), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")))
    # what is left without the short lines
    df = df.withColumn("__rest", F.regexp_replace("__plain", SHORT, ""))
    blanks = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    visible = lambda c: F.length(F.translate(c, " \n\r\t", ""))
    counts = F.struct(
        F.length(t).alias("chars"),
        F.when(F.length("__flat") <= 2, 0).otherwise(blanks("__flat") - 1).alias("words"),
        F.regexp_count("__flat", F.lit(f" (?={trie_pattern(all_words())} )")).alias("__common"),
        F.regexp_count("__plain", F.lit(r"\S++")).alias("__tokens"),
        F.regexp_count("__flat", F.lit(r" \p{N}++(?= )")).alias("__numbers"),
        F.regexp_count("__plain", F.lit(r"#|…|\.\.\.")).alias("__symbols"),
        visible("__plain").alias("__visible"),
        visible("__rest").alias("__long"),
        F.regexp_count("__plain", F.lit(r"(?md)^[ \t\r]*+[^ \t\r\n]")).alias("lines"),
        F.regexp_count("__plain", F.lit("[.!?…:][\"'”’»)]{0,2}+[ \\t\\r]*+(?=\n|\\z)")).alias("__ended"),
        F.regexp_count("__plain", F.lit(r"(?md)^[ \t]*+(?:[-–•*·☐›]|\[[ xX]?\]|#?\(?\d{1,3}[.)]?)[ \t]++\S")).alias("__bullets"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    # a generator, so that a filter on the verdict isn't pushed below (and computed apart from) the counts
    df = df.select(*items.columns, F.inline(F.array(counts)))
    df = df.select(
        *items.columns, "chars", "words", "lines", "__common",
        share(F.col("__visible"), F.col("__tokens")).alias("mean_word_length"),
        share(F.col("__common"), F.col("words")).alias("common_share"),
        share(F.col("words") - F.col("__numbers"), F.col("words")).alias("alphabetic_share"),
        share(F.col("__symbols"), F.col("__tokens")).alias("symbol_ratio"),
        share(F.col("__ended"), F.col("lines")).alias("ended_share"),
        share(F.col("__bullets"), F.col("lines")).alias("bullet_share"),
        share(F.col("__visible") - F.col("__long"), F.col("__visible")).alias("short_share"),
    )
    fails = [
        ("word_length", ~F.col("mean_word_length").between(*WORD_LENGTH)),
        ("few_alphabetic_words", F.col("alphabetic_share") < MIN_ALPHABETIC),
        ("symbols", F.col("symbol_ratio") > MAX_SYMBOLS),
        ("bullets", F.col("bullet_share") > MAX_BULLETS),
        ("few_stop_words", F.col("__common") < MIN_STOPS),
        ("short_lines_without_ends", (F.col("ended_share") < MIN_ENDED) & (F.col("short_share") > MAX_SHORT)),
        ("few_common_words", F.col("common_share") < MIN_COMMON),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fails]))
    judged = F.col("chars") >= MIN_CHARS
    df = df.withColumn("reasons", F.when(judged, reasons).when(F.col("chars").isNotNull(), F.array().cast("array<string>"))).withColumn("junk", F.size("reasons") > 0)
    return df.drop("__common")


def junk(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """item_id of the texts that are no natural prose."""
    return with_statistics(items.select(F.col(id_col).alias("item_id"), F.col(text).alias("text")), "text").filter("junk").select("item_id")
