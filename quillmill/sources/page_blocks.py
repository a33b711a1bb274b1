"""Text blocks of laid-out pages in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_text(blocks: DataFrame, doc: str = "doc_id", footer: float = 0.92, full: float = 0.7) -> DataFrame:
    """(doc, text): blocks without images, blanks and footers; per page full-width ones first, then down, then across.

    ``blocks``: doc, page_num, x0, y0, x1, y1, page_width, page_height, block_type (1 image), text.
    """
    wide = (F.col("x1") - F.col("x0")) / F.col("page_width") > full
    kept = blocks.filter((F.col("block_type") != 1) & (F.trim("text") != "") & (F.col("y0") / F.col("page_height") <= footer))
    row = F.struct("page_num", F.when(wide, 0).otherwise(1).alias("narrow"), "y0", "x0", F.trim("text").alias("text"))
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda b: b["text"]), "\n\n").alias("text"))
