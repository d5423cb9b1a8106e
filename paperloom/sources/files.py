"""Readers of files: PDFs, Markdown, converters' output, settings, device tables; and downloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect import not_empty, strip
from ..functions import images as I
from ..functions import titles


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the PDFs in a folder, whatever the case of their extension."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)


def checked_sources(sources: DataFrame, found: DataFrame, column: str = "source") -> DataFrame:
    """``sources`` with is_url and error: a local path must be among ``found`` (path) and end in .pdf."""
    known = found.select(F.regexp_replace("path", "^file:/*", "/").alias("_path")).distinct()
    out = sources.withColumn("is_url", titles.is_url(F.col(column))).join(known, F.col(column) == F.col("_path"), "left")
    error = F.when(F.col("is_url"), F.lit(None)).when(~F.lower(column).endswith(".pdf"), F.concat(F.lit("Not a PDF file: "), column)).when(F.col("_path").isNull(), F.concat(F.lit("File not found: "), column))
    return out.withColumn("error", error).drop("_path")


def fetch(url: str) -> tuple[bytes | None, str | None, str | None]:
    """(content, Content-Disposition, error) of a GET within 60 seconds, by the requests library."""
    try:
        import requests

        reply = requests.get(url, timeout=60)
        reply.raise_for_status()
        return reply.content, reply.headers.get("Content-Disposition"), None
    except Exception as e:  # a failed download is a row's error
        return None, None, f"Failed to download PDF: {e}"


def downloads(urls: DataFrame, column: str = "source", get: Callable = fetch) -> DataFrame:
    """``urls`` with content, path (the download's name) and error."""
    schema = T.StructType([*urls.schema, T.StructField("content", T.BinaryType()), T.StructField("disposition", T.StringType()), T.StructField("error", T.StringType())])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [get(u) for u in batch[column]]
            yield batch.assign(content=[c for c, _, _ in found], disposition=[d for _, d, _ in found], error=[e for _, _, e in found])

    out = urls.mapInPandas(step, schema)
    return out.withColumn("path", titles.download_name(F.col(column), F.col("disposition"))).drop("disposition")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of Markdown files, whole; the extension is .md in small letters."""
    read = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").format("text").load(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def chosen_output(files: DataFrame, stem: Column, key: str) -> DataFrame:
    """Of a converter's Markdown files (key, path, markdown) the one named like the document, else the first by path."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(titles.path_stem(F.col("path")) == stem, 0).otherwise(1), "path"))
    return files.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the image files in a folder, by name."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.withColumn("name", I.base_name(F.col("path"))).where(I.is_image(F.col("name"))).select("path", "name", "content")


def settings(spark: SparkSession, path: str, existing: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines of a file; what exists already wins. A settings file is small, so it is read on the driver."""
    line = strip(F.col("value"))
    rows = spark.read.text(path).where(~line.startswith("#") & line.contains("="))
    key, value = strip(F.split(line, "=", 2)[0]), strip(F.split(line, "=", 2)[1])
    quoted = value.rlike("(?s)\\A(?:\"[^\"]*\"|'[^']*')\\z") & (F.length(value) >= 2)
    found = rows.select(key.alias("k"), F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("v"))
    out: dict[str, str] = {}
    for r in found.where(not_empty(F.col("k")).isNotNull()).collect():
        out.setdefault(r["k"], r["v"])
    return out | (existing or {})


def devices(rows: DataFrame, column: str = "value") -> DataFrame:
    """(idx, mem, util, scan_pos) of a device table's lines ``idx, mem, util``; other lines are left out. rows: (scan_pos, ``column``)."""
    parts = F.split(F.col(column), ",")
    number = lambda i: F.expr(f"try_cast(trim(split({column}, ',')[{i}]) as int)")
    out = rows.where(F.size(parts) == 3).select(number(0).alias("idx"), number(1).alias("mem"), number(2).alias("util"), "scan_pos")
    return out.where("idx is not null and mem is not null and util is not null")
