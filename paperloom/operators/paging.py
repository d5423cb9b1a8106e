"""Page ranges and the devices that work on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect import strip

#: Workers at most for one document.
MOST_WORKERS = 4


def page_ranges(pages: Column, workers: Column) -> Column:
    """An array of (chunk_idx, start_page, end_page), from 0 and inclusive; it may have fewer than ``workers``."""
    n = F.greatest(F.least(workers, pages), F.lit(1))
    size = F.ceil(pages / n).cast("int")
    one = lambda i: F.struct(i.alias("chunk_idx"), (i * size).alias("start_page"), (F.least((i + 1) * size, pages) - 1).cast("int").alias("end_page"))
    ranges = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), one)
    return F.when(pages > 0, F.filter(ranges, lambda r: r["start_page"] <= r["end_page"])).otherwise(F.array().cast("array<struct<chunk_idx:int,start_page:int,end_page:int>>"))


def exploded_ranges(docs: DataFrame, pages: str = "pages", workers: Column | int = MOST_WORKERS) -> DataFrame:
    workers = workers if isinstance(workers, Column) else F.lit(workers)
    return docs.withColumn("_r", F.explode(page_ranges(F.col(pages), workers))).select(*docs.columns, "_r.*")


def free_devices(devices: DataFrame, most_memory: int = 2000, most_use: int = 10) -> DataFrame:
    """Devices (idx, mem, util, scan_pos) with little in use, and ``gpu_pos`` from 0: by memory, equal ones in the order of the scan.

    A machine's devices are few, so their window has one partition.
    """
    from pyspark.sql import Window

    free = devices.where((F.col("mem") < most_memory) & (F.col("util") < most_use))
    return free.withColumn("gpu_pos", F.row_number().over(Window.orderBy("mem", "scan_pos")) - 1)


def listed_devices(setting: Column) -> Column:
    """Devices named in an environment setting: neither filtered nor sorted."""
    return F.filter(F.transform(F.split(setting, ","), lambda x: strip(x)), lambda x: x != "")


def worker_count(devices: Column, pages: Column, most: int = MOST_WORKERS) -> Column:
    return F.greatest(F.lit(1), F.least(devices, pages, F.lit(most)))


def assigned(chunks: DataFrame, devices: DataFrame) -> DataFrame:
    """Chunks with the device of their turn; ``devices`` as from ``free_devices``, a machine's few, is broadcast as one array."""
    gpus = devices.agg(F.transform(F.array_sort(F.collect_list(F.struct("gpu_pos", "idx"))), lambda x: x["idx"]).alias("_gpus"))
    return chunks.crossJoin(F.broadcast(gpus)).withColumn("gpu", F.get("_gpus", (F.col("chunk_idx") % F.greatest(F.size("_gpus"), F.lit(1))).cast("int"))).drop("_gpus")
