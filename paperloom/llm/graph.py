"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, join_spread, stored


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_spread(both.where("v > u"), least, ["u"], "n", 2 * total, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_spread(down, least, ["u"], "n", total, "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component): each vertex of ``edges`` (u long, v long) that isn't the least of its component, and that least.

    Self-loops and repeated edges change nothing; rows with a null end are left out. Each
    round's edges are a table in the shared folder. Rounds end when one changes nothing. The
    edges of a vertex with many are spread over tasks.
    """
    now = stored(edges.where("u <> v").select("u", "v").distinct())
    total, before = now.count(), None
    while total:
        wide = stored(_large_star(now, total))
        nxt = stored(_small_star(wide, total))
        sign = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_stored(now, wide)
        now = nxt
        if sign == before:
            break
        total, before = sign[0], sign
    return now.select("u", F.col("v").alias("component"))
