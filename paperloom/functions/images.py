"""Image references and what they are mapped to.

A map is an array of structs (ord, old, new), in the order in which first matches are sought.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dialect import not_empty, rebuilt

REFERENCE = r"!\[([^\]]*)\]\(([^)]+)\)"
# The extensions of image files.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"[^./](\.[^./]+)\z", 1)


def is_image(name: Column) -> Column:
    return F.lower(extension(name)).isin(*EXTENSIONS)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def _rewritten(md: Column, target) -> Column:
    def one(match: Column, _: Column) -> Column:
        alt, old = F.regexp_extract(match, REFERENCE, 1), F.regexp_extract(match, REFERENCE, 2)
        new = target(old)
        return F.when(new.isNotNull(), F.concat(F.lit("!["), alt, F.lit("]("), new, F.lit(")"))).otherwise(match)

    return rebuilt(md, REFERENCE, one)


def _first(entries: Column, which) -> Column:
    return F.get(F.filter(entries, which), 0)["new"]


def rewrite_in_chunk(md: Column, entries: Column) -> Column:
    """By the whole path, then by the file's name, where the map has both."""
    return _rewritten(md, lambda old: F.coalesce(_first(entries, lambda e: e["old"] == old), _first(entries, lambda e: e["old"] == base_name(old))))


def rewrite_from_api(md: Column, entries: Column, quirks: str = "reference") -> Column:
    """By the whole path, then by the first entry of which one contains the other; with ``quirks="fixed"`` by the file's name instead."""
    if quirks != "reference":
        return _rewritten(md, lambda old: F.coalesce(_first(entries, lambda e: e["old"] == old), _first(entries, lambda e: base_name(e["old"]) == base_name(old))))
    return _rewritten(md, lambda old: F.coalesce(_first(entries, lambda e: e["old"] == old), _first(entries, lambda e: old.contains(e["old"]) | e["old"].contains(old))))


def rewrite_from_cli(md: Column, entries: Column) -> Column:
    """By the whole path, then by the first entry that ends with the file's name."""
    return _rewritten(md, lambda old: F.coalesce(_first(entries, lambda e: e["old"] == old), _first(entries, lambda e: e["old"].endswith(base_name(old)))))


def decode_data_uri(c: Column) -> Column:
    """The bytes of a base64 data URI; NULL if it is none."""
    return F.when(c.contains(";base64,"), F.try_to_binary(F.substring(c, F.locate(";base64,", c) + 8, F.length(c)), F.lit("base64")))


def api_extension(name: Column) -> Column:
    return F.coalesce(not_empty(extension(name)), F.lit(".jpg"))
