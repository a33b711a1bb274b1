"""Address keys and what can be read from an address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import lexicons as L


def url_key(url: Column) -> Column:
    """D3: sixteen hexadecimal digits of the address without case, end slashes, query and fragment."""
    bare = F.regexp_replace(F.trim(F.lower(url)), "/+$", "")
    return F.left(F.md5(F.regexp_replace(bare, r"(?s)[?#].*$", "")), F.lit(16))


def video_id(url: Column, patterns: list[str] = L.VIDEO_URLS) -> Column:
    """The eleven-character id in any of the known address forms, or null."""
    return F.coalesce(*[F.when(F.regexp_extract(url, p, 1) != "", F.regexp_extract(url, p, 1)) for p in patterns])


def video_key(url: Column) -> Column:
    """Keyed by the video where there is one, else as D3."""
    v = video_id(url)
    return F.when(v.isNotNull(), F.left(F.md5(F.concat(F.lit("youtube:"), v)), F.lit(16))).otherwise(url_key(url))


def host(url: Column) -> Column:
    """The address's host, lower-cased, every "www." left out."""
    return F.replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def title_of_url(url: Column) -> Column:
    """A readable title from the last path segment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    seg = F.element_at(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), -1)
    bare = F.regexp_replace(F.regexp_replace(seg, r"\.(html?|php|aspx?)$", ""), "[-_]", " ")
    bare = F.regexp_replace(bare, r"\d{4}[-/]\d{2}[-/]\d{2}[-/]?", "")
    out = F.initcap(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    return F.when(out == "", "Untitled").otherwise(out)


def first_pattern(url: Column, patterns: list[tuple[str, str]]) -> Column:
    """The value of the first configured pattern found in the address; null if none is.

    The patterns are configuration, so they are one expression and no join.
    """
    return F.coalesce(*[F.when(F.instr(F.lower(url), p) > 0, F.lit(v)) for p, v in patterns])
