"""Rule filter, signal families and the opening gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import lexicons as L
from quillmill.functions.text import any_of, contains_word, first_words, matches, sentences, stripped, tokens, word_count, words


def signals(text: Column, families: dict[str, list[str]] = L.SIGNALS) -> Column:
    """R2: the families with at least one phrase in the text."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + any_of(p)), F.lit(n)) for n, p in families.items()]))


def quotation_share(text: Column) -> Column:
    """Characters between quotation marks by all characters."""
    parts = F.regexp_extract_all(text, F.lit('["“”]([^"“”]*)["“”]'), F.lit(1))
    quoted = F.aggregate(F.transform(parts, F.length), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(text) > 0, quoted / F.length(text)).otherwise(F.lit(0.0))


def list_without_meaning(text: Column, meaning: list[str] = L.MEANING) -> Column:
    """Three lines or more, most of them list items, and no sentence that sums up."""
    filled = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
    items = F.filter(filled, lambda x: x.rlike(r"(?i)^(\d+[.)]\s|[-•*]\s|[a-z][.)]\s)"))
    return (F.size(filled) >= 3) & (F.size(items) / F.size(filled) > 0.5) & ~text.rlike("(?i)" + any_of(meaning))


def rule_decision(text: Column, count: Column, least: int = 250, most: int = 900, quoted: float = 0.30, families: dict[str, list[str]] = L.SIGNALS) -> Column:
    """The first rule that drops the text, or PASS."""
    found = signals(text, families)
    return (
        F.when(count < least, "WORD_COUNT_LOW")
        .when(count > most, "WORD_COUNT_HIGH")
        .when(matches(text, L.META_STRUCTURAL) >= 2, "META_STRUCTURAL")
        .when(matches(text, L.INDEX_REFERENCE) >= 5, "INDEX_REFERENCE")
        .when((matches(text, L.BIOGRAPHY) >= 3) & (F.size(found) == 0), "PURE_BIOGRAPHY")
        .when(quotation_share(text) > quoted, "QUOTATION_DUMP")
        .when(list_without_meaning(text), "LIST_WITHOUT_MEANING")
        .when(F.size(found) == 0, "NO_SIGNAL")
        .otherwise("PASS")
    )


def opening_gate(text: Column) -> Column:
    """V1: whether a text's opening could hold a reader."""
    parts = sentences(text)
    first = F.lower(F.get(parts, F.lit(0)))
    head = F.lower(first_words(text, 100))
    question = F.instr(F.array_join(F.slice(parts, 1, 2), ". "), "?") > 0
    address = (F.instr(head, " you ") > 0) | first.startswith("you")
    contrast = F.lit(False)
    for w in L.CONTRAST_OPENING:
        contrast = contrast | contains_word(head, w)
    feeling = F.size(F.array_intersect(tokens(head), F.array(*map(F.lit, L.EMOTIONAL)))) >= 2
    opener = F.lit(False)
    for w in L.STRONG_OPENERS:
        opener = opener | (F.instr(first, w) > 0)
    brief = word_count(first) <= 20
    explains = F.size(F.filter(parts, lambda s: F.lower(s).rlike(any_of(L.EXPLAINER_STARTERS))))
    heavy = (F.size(parts) > 3) & (explains / F.size(parts) > 0.5)
    killed = first.rlike("(?i)" + any_of(L.KILL))
    return F.coalesce((F.size(parts) > 0) & ~killed & (question | address | contrast | feeling | opener | brief) & ~heavy, F.lit(False))


__all__ = ["signals", "quotation_share", "list_without_meaning", "rule_decision", "opening_gate", "words"]
