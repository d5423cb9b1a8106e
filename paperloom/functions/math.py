"""Mathematical notation: delimiters and inline wrapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dialect import DIGIT, LINE_WS, WORD, WORD_START, WS, rebuilt, replace

# The environments that are wrapped, and the signs that count as mathematics.
ENVIRONMENTS = ("equation", "equation*", "align", "align*", "multline", "multline*", "gather", "gather*", "split", "cases")
SIGNS = "αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΘΛΞΠΣΦΨΩ∈∀∃∅∇∞∝∑∏∫∂"
#: Marks around a wrapped environment while its neighbours are looked at; no text has them (they are noncharacters).
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
#: A fenced block, or what follows an opening fence to the end.
FENCED = rf"(?sm)^{LINE_WS}*+```[^\n]*(?:\n|\z)(?:.*?^{LINE_WS}*+```[^\n]*(?:\n|\z)|.*\z)"


def outside_code(c: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to each stretch between fenced blocks by itself; fenced lines stay as they are."""
    return rebuilt(c, FENCED, lambda m: m, change)


def inline_delimiters(c: Column) -> Column:
    return replace(c, r"(?s)\\\((.+?)\\\)", r"\$$1\$")


def display_delimiters(c: Column) -> Column:
    return replace(c, r"(?s)\\\[(.+?)\\\]", r"\$\$$1\$\$")


def wrap_environments(c: Column) -> Column:
    """``$$`` lines around environments, save those between ``$$`` and ``$$`` already."""
    names = "|".join(n.replace("*", r"\*") for n in ENVIRONMENTS)
    out = replace(c, rf"(?s)\\begin\{{({names})\}}.*?\\end\{{\1\}}", rf"{_OPEN}\$\$\n$0\n\$\${_CLOSE}".replace(r"\n", "\n"))
    out = replace(out, rf"(?<=\$\$){_OPEN}\$\$\n([^{_CLOSE}]*)\n\$\${_CLOSE}(?=\$\$)", "$1")
    return replace(out, f"[{_OPEN}{_CLOSE}]", "")


def normalize_delimiters(c: Column) -> Column:
    return outside_code(c, lambda x: wrap_environments(display_delimiters(inline_delimiters(x))))


def wrap_subscripts(c: Column) -> Column:
    return replace(c, rf"{WORD_START}([A-Za-z]){WS}*_{WS}*({WORD}+)", r"\$$1_$2\$")


def wrap_signs(c: Column) -> Column:
    return replace(c, rf"(?<![\$A-Za-z])([{SIGNS}])(?![A-Za-z])", r"\$$1\$")


def wrap_number_first(c: Column) -> Column:
    return replace(c, rf"({DIGIT}+){WS}*([≤≥≈≠<>]){WS}*({WORD}+)", r"\$$1 $2 $3\$")


def wrap_number_last(c: Column) -> Column:
    return replace(c, rf"({WORD}+){WS}*([≤≥≈≠]){WS}*({DIGIT}+)", r"\$$1 $2 $3\$")


def wrap_comparisons(c: Column) -> Column:
    return wrap_number_last(wrap_number_first(c))


def wrap_inline(c: Column, quirks: str = "reference") -> Column:
    """Inline mathematics in ``$``. With ``quirks="fixed"`` what is mathematics, code, a link or a tag already is left alone."""
    every = lambda x: wrap_comparisons(wrap_signs(wrap_subscripts(x)))
    if quirks == "reference":
        return outside_code(c, every)
    taken = r"(?s)\$\$.+?\$\$|\$[^$\n]+\$|`[^`\n]+`|\]\([^)\n]+\)|<[^>\n]+>"
    return outside_code(c, lambda x: rebuilt(x, taken, lambda m: m, every))


def replace_image_marks(c: Column, count: Column) -> Column:
    """The k-th ``<!-- image -->`` becomes the k-th figure, as far as there are figures."""

    def figure(m: Column, i: Column) -> Column:
        k = (i + 1).cast("int")
        return F.when(k <= count, F.concat(F.lit("![Figure "), k.cast("string"), F.lit("](./assets/"), image_name(k, F.lit(".png")), F.lit(")"))).otherwise(m)

    return rebuilt(c, rf"<!--{WS}*image{WS}*-->", figure)


def image_name(n: Column, extension: Column) -> Column:
    return F.format_string("image_%03d%s", n, extension)
