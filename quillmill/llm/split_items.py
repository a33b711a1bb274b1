r"""Problem 2: oversized items cut at natural boundaries, with overlap.

One bounded-quantifier expression extracts the pieces' own parts: its alternatives, strongest
boundary first, consume up to the limit and give back to the last boundary in the second half of
it, else to one in the first; a bare character is the last resort. A look back at the end of the part before supplies the
overlap. All of it is array functions over one extraction, linear in the text's length.

Defined results: null text gives no piece; an empty text is one empty piece; a text of at most
``limit`` characters is one piece, unchanged; pieces' own parts joined give the text back; rows
delivered twice count once; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A piece's characters, and those of the piece before that it starts with.
LIMIT, OVERLAP = 6000, 300


def boundary_pattern(size: int) -> str:
    """Parts of at most ``size`` characters: the rest, else up to a paragraph, line, sentence, clause, word, character."""
    h = max(1, size // 2)
    ends = [
        r"(?<=\n[ \t\r ]{0,4}\n)(?!\s)",
        r"(?<=\n)(?!\n)",
        r"(?<=[.!?…][\"'”’»)\]]{0,2}[\s ])(?=\S)",
        r"(?<=[,;:)–—][\s ])(?=\S)",
        r"(?<=[\s ])(?=\S)",
    ]
    full = ["(?:.{%d,%d})" % (h, size) + e for e in ends]
    short = ["(?:.{1,%d})" % h + e for e in ends]
    return "|".join([r"(?s).{1,%d}\z" % size, *full, *short, r"(?:.{%d,%d})(?!\p{M})" % (h, size), ".{1,%d}" % size])


def own_parts(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The pieces' own parts, in order; joined they give the text back."""
    pattern = F.lit(boundary_pattern(limit - overlap))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.regexp_extract_all(text, pattern, F.lit(0)))


def with_overlaps(own: Column, overlap: int = OVERLAP) -> Column:
    """array<struct<overlap_chars int, text string>> of own parts; ``own`` must be a column, for it is used repeatedly."""
    # the last `overlap` characters of the piece before, and one more to see whether a word is cut;
    # two parts reach back far enough: a part shorter than half the limit has a longer one beside it
    long_ = lambda p: F.length(p) > overlap
    last = lambda p: F.right(p, F.lit(overlap + 1))
    back = F.transform(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), lambda p, i: F.when(long_(p), last(p)).otherwise(last(F.concat(F.coalesce(F.get(own, i - 1), F.lit("")), p))))
    # cut to start at a word if one starts soon
    soon = min(60, overlap // 3)
    inside = lambda w: long_(w) & F.substring(w, 1, 1).rlike(r"\S")
    window = lambda w: F.right(w, F.lit(overlap))
    tail = lambda w: F.when(inside(w), F.regexp_replace(window(w), r"(?s)\A\S{0,%d}\s+(?=\S)" % soon, "")).otherwise(F.regexp_replace(window(w), r"\A\s+(?=\S)", ""))
    tails = F.concat(F.array(F.lit("")), F.transform(back, tail))
    return F.transform(F.arrays_zip(tails.alias("t"), own.alias("o")), lambda x: F.struct(F.length(x["t"]).alias("overlap_chars"), F.concat(x["t"], x["o"]).alias("text")))


def split_items(items: DataFrame, id_col: str, text: str = "text", index: str = "chunk_index", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, chunk_index, pieces, piece_no, overlap_chars, text): every item as pieces of at most ``limit`` characters."""
    rows = items.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(index).alias("chunk_index"), F.col(text).alias("text"))
    parts = rows.select("item_id", "chunk_index", own_parts(F.col("text"), limit, overlap).alias("own"))
    arr = parts.select("item_id", "chunk_index", with_overlaps(F.col("own"), overlap).alias("p"))
    return arr.select("item_id", "chunk_index", F.size("p").alias("pieces"), F.posexplode_outer("p").alias("piece_no", "x")).filter("x is not null").select(
        "item_id", "chunk_index", "pieces", "piece_no", "x.overlap_chars", "x.text"
    )


def oversized(items: DataFrame, id_col: str, text: str = "text", index: str = "chunk_index", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, chunk_index) of the items the splitter cuts, once each."""
    return split_items(items, id_col, text, index, limit, overlap).filter("pieces > 1 and piece_no = 0").select("item_id", "chunk_index").distinct()
