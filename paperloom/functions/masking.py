"""Spans that a translator must not touch: their patterns, masks and return."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import DIGIT, WS, replace, strip

# The classes in the order in which they are masked, as (type, pattern for Java and RE2, pattern for Python).
PATTERNS = (
    ("LATEX_DISPLAY", r"(?s)\$\$.+?\$\$", r"\$\$[\s\S]+?\$\$"),
    ("LATEX_INLINE", r"\$[^$\n]+?\$", r"\$[^$\n]+?\$"),
    ("CODE_BLOCK", r"(?s)```.*?```", r"```[\s\S]*?```"),
    ("INLINE_CODE", r"`[^`\n]+?`", r"`[^`\n]+?`"),
    ("IMAGE_REF", r"!\[[^\]]*\]\([^)]+\)", r"!\[[^\]]*\]\([^)]+\)"),
    ("LINK_URL", r"\]\([^)]+\)", r"\]\([^)]+\)"),
    ("HTML_TAG", r"<[^>]+>", r"<[^>]+>"),
    ("CITATION", rf"\[{DIGIT}+(?:,{WS}*{DIGIT}+)*\]", r"\[\d+(?:,\s*\d+)*\]"),
    ("HR", r"(?m)^---+$", r"^---+$"),
)
_SPAN = T.StructType([T.StructField("n", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("ptype", "placeholder", "original")]])


def java(pattern: str) -> str:
    """Only a line feed ends a line."""
    return pattern.replace("(?m)", "(?md)")


def mask_counts(c: Column) -> dict[str, Column]:
    """How many spans of each class are masked, natively: each class is counted after those before it are masked."""
    out = {}
    for name, pattern, _ in PATTERNS:
        out[name] = F.regexp_count(c, F.lit(java(pattern)))
        c = replace(c, java(pattern), f"⟦{name}⟧")
    return out


def mask_text(text: str) -> tuple[str, list[tuple[int, str, str, str]]]:
    spans: list[tuple[int, str, str, str]] = []
    for name, _, pattern in PATTERNS:

        def hide(match: re.Match, name: str = name) -> str:
            token = f"⟦{name}_{len(spans) + 1}⟧"
            spans.append((len(spans) + 1, name, token, match[0]))
            return token

        text = re.sub(pattern, hide, text, flags=re.MULTILINE)
    return text, spans


def with_masks(df: DataFrame, column: str) -> DataFrame:
    """``df`` with masked, the masked text of ``column``, and spans, numbered by class and then by place.

    Later classes see earlier masks, so a span can hold another's mask; for that this isn't an
    expression. A null text is masked as an empty one.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [mask_text(x or "") for x in batch[column]]
            yield batch.assign(masked=[t for t, _ in found], spans=[[dict(zip(_SPAN.names, x, strict=True)) for x in s] for _, s in found])

    schema = T.StructType([*df.schema, T.StructField("masked", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN))])
    return df.mapInPandas(step, schema)


def unmask(text: Column, spans: Column, quirks: str = "reference") -> Column:
    """Spans put back: in the order in which they were masked, which leaves masks within spans; with ``quirks="fixed"`` in reverse, which leaves none."""
    ordered = spans if quirks == "reference" else F.reverse(spans)
    return F.aggregate(ordered, text, lambda acc, s: F.replace(acc, s["placeholder"], s["original"]))


def mostly_masked(chunk: Column) -> Column:
    """Whether a chunk has under 20 characters besides masks."""
    return F.length(strip(replace(chunk, "⟦[^⟧]+⟧", ""))) < 20
