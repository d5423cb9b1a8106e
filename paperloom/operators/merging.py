"""Chunks' results merged into documents, and their images renumbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions.math import image_name

PAGE_BREAK = "\n\n---\n\n"


def ordered_text(index: str, text: str, separator: str) -> Column:
    """Texts of a group joined in the order of ``index``, whatever the order in which they came."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t"))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), separator)


def renumbered(images: DataFrame, *order: str) -> DataFrame:
    """Images (doc_id, chunk_idx, name, markdown) that count, with ``n`` and ``new_name``: numbers run through the document.

    Images of a chunk without Markdown and files that are no images take no number.
    """
    kept = images.where((F.coalesce(F.col("markdown"), F.lit("")) != "") & I.is_image(F.col("name")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(order or ("chunk_idx", "name"))))
    return kept.withColumn("n", n).withColumn("new_name", image_name(F.col("n"), I.extension(F.col("name"))))


def merge_chunks(chunks: DataFrame, images: bool = False, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(doc_id, markdown, n_chunks, n_images, failed_chunks, status, message) of chunks (doc_id, chunk_idx, markdown, names).

    Chunks are joined in order, empty ones left out; each one's references to its images get
    the numbers that the images have in the document. The window and the aggregate share one
    exchange by doc_id. With ``images`` chunks have images (name, bytes) in place of names, and
    ``whole`` where a chunk is a document of its own; the result has images, by their new names,
    and the first value of each column of ``keep`` that isn't null.
    """
    w = Window.partitionBy("doc_id").orderBy("chunk_idx")
    good = F.coalesce(F.col("markdown"), F.lit("")) != ""
    if images:
        chunks = chunks.withColumn("images", F.array_sort(F.filter(F.coalesce("images", F.array().cast("array<struct<name:string,bytes:binary>>")), lambda x: I.is_image(x["name"]))))
        chunks = chunks.withColumn("names", F.transform("images", lambda x: x["name"]))
    names = F.when(good, F.array_sort(F.filter(F.coalesce("names", F.array().cast("array<string>")), I.is_image))).otherwise(F.array().cast("array<string>"))
    rows = chunks.withColumn("_names", names)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.size("_names")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def new_name(name: Column, i: Column) -> Column:
        return image_name((F.col("_before") + i + 1).cast("int"), I.extension(name))

    def entry(prefix: str):
        return lambda x, i: F.struct((i * 2).alias("ord"), F.concat(F.lit(prefix), x).alias("old"), F.concat(F.lit("./assets/"), new_name(x, i)).alias("new"))

    entries = F.concat(F.transform("_names", entry("images/")), F.transform("_names", entry("")))
    rewritten = I.rewrite_in_chunk(F.col("markdown"), entries)
    extra = []
    if images:
        rewritten = F.when(F.col("whole"), I.rewrite_from_cli(F.col("markdown"), F.transform("_names", entry("images/")))).otherwise(rewritten)
        named = F.when(good, F.transform("images", lambda x, i: F.struct(new_name(x["name"], i).alias("name"), x["bytes"].alias("bytes"))))
        rows = rows.withColumn("_images", named)
        listed = F.array_sort(F.collect_list(F.when(good, F.struct(F.col("chunk_idx").alias("i"), F.col("_images").alias("x")))))
        extra = [F.flatten(F.transform(listed, lambda x: x["x"])).alias("images"), *[F.any_value(c, ignoreNulls=True).alias(c) for c in keep]]
    rows = rows.withColumn("_md", F.when(good, rewritten))
    pairs = F.array_sort(F.collect_list(F.when(good, F.struct(F.col("chunk_idx").alias("i"), F.col("_md").alias("t")))))
    out = rows.groupBy("doc_id").agg(
        F.array_join(F.transform(pairs, lambda x: x["t"]), PAGE_BREAK).alias("markdown"),
        F.count("*").alias("n_chunks"),
        F.sum(F.size("_names")).alias("n_images"),
        F.count_if(~good).alias("failed_chunks"),
        *extra,
    )
    failed = F.col("markdown") == ""
    return out.withColumn("status", F.when(failed, "error").otherwise("success")).withColumn("message", F.when(failed, "All chunks failed to convert"))
