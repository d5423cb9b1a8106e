"""Papers that are there already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect import replace


def title_key(dir_name: Column) -> Column:
    """A folder's title, without a date before it."""
    return replace(dir_name, r"\A\p{Nd}{8}-", "")


def split_duplicates(incoming: DataFrame, catalog: DataFrame, order: str, force: bool = False) -> DataFrame:
    """``incoming`` (with title_key) and ``is_duplicate``: the catalog has its title, or an earlier row of the batch.

    The batch rule makes one run over many papers equal to many runs over one. Rows with one
    ``order`` are told apart by a hash of their columns; equal rows count alike. ``catalog``
    has title_key. Titles and orders alone are aggregated, before the shuffle, so a frequent
    title is no large group; neither side is broadcast by hand, as both may be large.
    """
    if force:
        return incoming.withColumn("is_duplicate", F.lit(False))
    known = catalog.select(F.col("title_key").alias("_known")).distinct()
    place = F.struct(F.col(order).alias("at"), F.xxhash64(*[c for c, kind in incoming.dtypes if not kind.startswith(("map", "variant"))]).alias("hash"))
    first = incoming.groupBy(F.col("title_key").alias("_title")).agg(F.min(place).alias("_first"))
    firsts = first.join(known, F.col("_title") == F.col("_known"), "left").select("_title", "_first", F.col("_known").isNotNull().alias("_there"))
    out = incoming.join(firsts, F.col("title_key").eqNullSafe(F.col("_title")), "left")
    return out.withColumn("is_duplicate", F.col("_there") | ~place.eqNullSafe(F.col("_first"))).drop("_title", "_first", "_there")
