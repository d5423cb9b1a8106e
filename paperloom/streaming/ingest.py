"""An extension: papers ingested as they arrive.

The stream reads new files; titles are made duplicates of each other within a watermark, and
each batch is checked against the folders that are there when it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.ingest import ingest, planned_writes
from ..sources import paperdir


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (source, markdown, arrived) of Markdown files in a folder."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").load(path)
    return read.select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("markdown"), F.col("modificationTime").alias("arrived"))


def first_arrivals(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One row for each text within ``lateness``, with its state bounded by the watermark."""
    return stream.withColumn("text_key", F.sha2("markdown", 256)).withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["text_key"])


def writer(stream: DataFrame, root: str, run_date: str, engine: str = "passthrough") -> DataStreamWriter:
    """A writer of each batch into paper directories below ``root``; a batch that runs again writes the same files."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        paperdir.register(spark)
        existing = spark.read.format("paperdir").load(root).where(~F.col("dir_name").startswith(F.lit(run_date.replace("-", "") + "-")))
        rows = batch.select("source", "markdown", F.lit(None).cast("string").alias("detected_title"), F.lit(None).cast("string").alias("meta_title"))
        planned_writes(ingest(rows, existing, F.lit(run_date).cast("date"), engine)).write.format("paperdir").mode("append").save(root)

    return stream.writeStream.foreachBatch(write)
