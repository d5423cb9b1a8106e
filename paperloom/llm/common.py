"""What the operators of this subpackage share: reading, shared-folder tables, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, and bytes of text that a numpy step takes at once; they bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 20_000, 6 << 20
STEP_BYTES = 4 << 20


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares (``spark.checkpoint.dir``); our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: tables need a folder that the whole cluster sees")
        root = tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: it cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # nothing reads this write's shuffles again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more; other frames are let be."""
    for df in frames:
        if not hasattr(df, "_stored_at"):
            continue
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key with over HOT_ROWS rows, or over its share of 1 / HOT_KEYS of all, is spread over tasks; so there are HOT_KEYS of these at most.
HOT_ROWS, HOT_KEYS = 500, 10_000


def join_spread(rows: DataFrame, unique: DataFrame, keys: list[str], n: str, total: int, salt: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``unique``, which has a row for each value of ``keys`` and in ``n`` at most how many rows have it; ``total``: the sum of n at most.

    Rows of a frequent key go to as many tasks as it takes, by column ``salt``, and its row of
    ``unique`` to each. The frequent keys are broadcast: HOT_KEYS small rows at most.
    """
    limit = max(HOT_ROWS, -(-total // HOT_KEYS))
    parts = unique.withColumn("_parts", F.ceil(F.col(n) / limit).cast("int"))
    hot = F.broadcast(parts.where("_parts > 1").select(*keys, F.col("_parts").alias("_of")))
    part = F.coalesce(F.pmod(F.xxhash64(salt), F.col("_of")).cast("int"), F.lit(0))
    left = rows.join(hot, keys, "left").withColumn("_part", part).drop("_of")
    right = parts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


#: What a Python worker keeps from task to task, by name, and the names that its present task has asked for.
_HELD: dict = {}
_ASKED: set = set()


def worker_held(name, make: Callable):
    """``make()``, made once in a Python worker; it goes when the worker turns to a task that doesn't ask for it."""
    _ASKED.add(name)
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def new_task(begin: Callable):
    """``begin()``; what it doesn't ask for is let go, so that workers don't keep memory for other steps."""
    _ASKED.clear()
    out = begin()
    gone = [name for name in _HELD if name not in _ASKED]
    for name in gone:
        del _HELD[name]
    if gone:
        give_back()
    return out


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone


def give_back() -> None:
    """Return to the system what this process has freed: else a worker that waits, or does a small step, keeps the most that any step took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most; a larger row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_arrow(df: DataFrame, begin: Callable[[], Callable[[pa.RecordBatch], dict]], schema, weigh: str | None = "text", step_bytes: int = STEP_BYTES) -> DataFrame:
    """``mapInArrow``: ``begin()`` gives each task's step, which gets batches of about STEP_BYTES of column ``weigh`` and returns columns by name."""
    spark = df.sparkSession
    bounded_batches(spark)
    out = pa.schema([(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = new_task(begin)
        for batch in batches:
            for part in slices(batch, weigh, step_bytes):
                columns = step(part)
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in out], schema=out)
        batch = part = columns = step = None
        give_back()

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(batch: pa.RecordBatch, weigh: str | None, step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    if weigh is None:
        yield batch
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(weigh)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + step_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each (start, length), one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary column, and where each row begins (one more than rows); null: empty."""
    import pyarrow.compute as pc

    kind = pa.large_binary()
    column = pc.fill_null(column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else kind).cast(kind), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]
