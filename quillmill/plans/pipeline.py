"""End-to-end composition (E5): document text to chosen passages in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.chunking import paragraph_chunks
from quillmill.operators.cleaning import cleaned
from quillmill.operators.elite import AXES, elite
from quillmill.operators.rules import opening_gate, rule_decision
from quillmill.operators.scores import axis_scores


def passages(docs: DataFrame, id_col: str, text: str, pages: str | None = None, families: dict[str, list[str]] | None = None, axes=AXES, least: int = 250, most: int = 900, hard: int = 1100, rules: bool = True) -> DataFrame:
    """Clean, chunk, filter, gate, score, choose. Only the choice shuffles (once, by document)."""
    clean = cleaned(docs.filter(F.col(text).isNotNull()), id_col, text, pages)
    chunks = paragraph_chunks(clean, id_col, "cleaned", least=least, most=most, hard=hard)
    if rules:
        decision = rule_decision(F.col("text"), F.col("word_count"), least, most, **({"families": families} if families else {}))
        chunks = chunks.filter(decision == "PASS")
    scored = axis_scores(chunks.filter(opening_gate(F.col("text"))), "text")
    return elite(scored, id_col, "index", axes)
