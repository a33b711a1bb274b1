"""String helpers with the semantics of the usual scripting-language methods, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(patterns: list[str]) -> str:
    """One expression that finds any of the patterns."""
    return "|".join(f"(?:{p})" for p in patterns)


def words(text: Column) -> Column:
    """Runs of non-blank characters (Unicode white space parts them)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1)))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Parts between ". ", stripped, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\. "), stripped), lambda s: s != "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def matches(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """How many of the patterns are found in the text."""
    flag = "(?i)" if ignore_case else ""
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(text.rlike(flag + p).cast("int"), F.lit(0))
    return total


def contains_word(text: Column, word: str) -> Column:
    """The word between single blanks, the text's start and end counting as blanks."""
    return F.instr(F.concat(F.lit(" "), text, F.lit(" ")), f" {word} ") > 0


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def joined(arr: Column) -> Column:
    return F.array_join(arr, "\n")
