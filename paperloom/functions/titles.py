"""Folder names and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dialect import WORD_INNER, WS, WS_INNER, not_empty, replace, strip

UNTITLED = "untitled_paper"


def path_stem(c: Column) -> Column:
    """The last path segment without its last extension; a leading or trailing dot begins none."""
    name = F.regexp_extract(c, r"(?s)([^/]*)/*\z", 1)
    return replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def sanitize_filename(c: Column, quirks: str = "reference") -> Column:
    """A folder name. With ``quirks="fixed"`` dots and slashes of a title don't cut it short."""
    stem = path_stem(c) if quirks == "reference" else c
    out = replace(stem, r'[:?/\\*<>|"]', "")
    out = replace(out, f"[-{WS_INNER}]+", "_")
    out = replace(out, f"[^{WORD_INNER}]", "")
    return replace(replace(out, r"\A_+|_+\z", ""), "_+", "_")


def markdown_title(md: Column) -> Column:
    """The first heading of levels 1 to 3, wherever it stands; NULL if there is none."""
    return not_empty(strip(F.regexp_extract(md, rf"(?md)^{WS}*#{{1,3}}{WS}+(.+?){WS}*$", 1)))


def looks_like_placeholder(c: Column) -> Column:
    """Whether a title is blank, a path or address, an arXiv number, or digits and punctuation only."""
    low = replace(F.lower(strip(c)), r"\.pdf\z", "")
    return (strip(c) == "") | low.contains("http") | low.contains("/") | low.contains("\\") | low.rlike(r"\A\p{Nd}{4}\.\p{Nd}{4,5}(v\p{Nd}+)?\z") | low.rlike(r"\A[0-9._-]+\z")


def resolve_title(detected: Column, md: Column, metadata: Column, source: Column, is_url: Column) -> Column:
    """The best title at hand: a heading in place of a missing or placeholder one, else the detected one, the PDF's, the file's."""
    heading, detected = markdown_title(md), not_empty(detected)
    return F.coalesce(
        F.when(heading.isNotNull() & (detected.isNull() | looks_like_placeholder(detected)), heading),
        detected,
        not_empty(strip(metadata)),
        F.when(~is_url, path_stem(source)),
        F.lit(UNTITLED),
    )


def display_title(detected: Column, sanitized: Column) -> Column:
    return F.coalesce(not_empty(detected), F.replace(sanitized, F.lit("_"), F.lit(" ")))


def is_url(c: Column) -> Column:
    return c.rlike("(?i)^https?:")


def download_name(url: Column, disposition: Column | None = None) -> Column:
    """The name under which a download is kept."""
    named = F.lit(None).cast("string") if disposition is None else F.when(disposition.contains("filename="), not_empty(replace(F.substring_index(disposition, "filename=", -1), "\\A[\"']+|[\"']+\\z", "")))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), base)
    name = F.coalesce(named, not_empty(decoded))
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise("downloaded_paper.pdf")


def output_suffix(language: Column) -> Column:
    return F.left(F.lower(language), F.lit(2))


def blank(c: Column) -> Column:
    return c.rlike(rf"\A{WS}*\z")
