"""Paragraphs and greedy packing into chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paragraphs(c: Column) -> Column:
    return F.split(c, r"\n\n+", -1)


def greedy_chunks(c: Column, limit: int) -> Column:
    """Paragraphs packed in order into chunks of about ``limit`` characters; one that is longer stays whole.

    The fold keeps only the numbers of the paragraphs that begin a chunk.
    """
    parts = paragraphs(c)
    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("k"), F.array(F.lit(0)).alias("cuts"))

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p)
        full = (acc["length"] + n > limit) & (acc["k"] > F.element_at(acc["cuts"], -1))
        return F.struct(
            (F.when(full, F.lit(0)).otherwise(acc["length"]) + n + 2).alias("length"),
            (acc["k"] + 1).alias("k"),
            F.when(full, F.concat(acc["cuts"], F.array(acc["k"]))).otherwise(acc["cuts"]).alias("cuts"),
        )

    cuts = F.aggregate(parts, start, step, lambda acc: acc["cuts"])
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(F.size(parts)))
    return F.zip_with(cuts, ends, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), "\n\n"))
