"""Regular-expression building blocks that mean the same in Python, Java and RE2.

Java's and RE2's ``\\s``, ``\\w``, ``\\d`` and ``\\b`` differ from Python's for other than ASCII
text, so patterns are put together from the explicit classes below. Multi-line patterns carry
the flag ``d`` in Java, so that only a line feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's white space, and what stands inside brackets for it.
WS_INNER = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_INNER}]"
NOT_WS = f"[^{WS_INNER}]"
#: White space within a line.
LINE_WS = r"[\x{9}\x{b}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD_INNER = r"\p{L}\p{N}_"
WORD = f"[{WORD_INNER}]"
DIGIT = r"\p{Nd}"
WORD_START = f"(?<!{WORD})"


def replace(c: Column, pattern: str, by: str) -> Column:
    """``regexp_replace`` with a Java replacement string."""
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def strip(c: Column) -> Column:
    """Python's ``str.strip()``: all its white space, at both ends."""
    return replace(replace(c, f"^{WS}+", ""), f"{WS}+\\z", "")


def not_empty(c: Column) -> Column:
    """NULL for the empty string, as both count as absent."""
    return F.nullif(c, F.lit(""))


def lines(c: Column) -> Column:
    """Lines of a text, without their line feeds; a line feed at the end begins no line, and an empty text has none."""
    body = F.when(c.endswith("\n"), F.left(c, F.length(c) - 1)).otherwise(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; NULL if there is none or it is empty."""
    return not_empty(F.regexp_extract(c, pattern, group))


def rebuilt(c: Column, pattern: str, each_match, each_piece=None) -> Column:
    """``c`` with every match of ``pattern`` (a positive length) replaced by ``each_match(match, index)``, and what stands between by ``each_piece(piece)``."""
    pieces, matches = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    if each_piece:
        pieces = F.transform(pieces, each_piece)
    changed = F.concat(F.transform(matches, each_match), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, changed, lambda p, m: F.concat(p, m)), "")
