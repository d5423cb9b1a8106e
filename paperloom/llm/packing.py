"""Best-fit packing, planned over the histogram of lengths instead of over documents.

There are at most ``capacity`` different lengths, so the plan is made on the driver from
their counts. Each piece then takes the slot planned for its rank within its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, stored
from .tokens import with_end, worker_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, within long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """The documents' pieces, each with its task and its rank among the pieces of its length in that task.

    A document is its ids and ``end_id``. Those longer than ``capacity`` are cut into pieces of
    it; only the first may be shorter. Null text counts as empty, so it gives one piece of one
    id. Equal rows give equal pieces; a null doc_id stays null.
    """

    def begin():
        encoder, task = worker_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)

        def step(batch: pa.RecordBatch) -> dict:
            ids, bounds = with_end(*encoder.encode(batch.column("text")), end_id)
            n = np.diff(bounds)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity  # the first piece
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            at = bounds[row] + start
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at + length, strict=True)]
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order], side="left")
            within = np.empty(len(length), np.int64)
            within[order] = np.arange(len(length)) - first + seen[length[order]]
            np.add.at(seen, length, 1)
            return {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece, "start": start, "length": length, "ids_crc32": crc, "task": np.full(len(row), task), "within": within}

        return step

    return in_arrow(docs.select("doc_id", "text"), begin, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit over counts: (length, first rank, number, first sequence, offset), lengths descending.

    Sequences with equal room are groups (first sequence, number); each step fills the group
    with the least room that is enough, and splits it if fewer pieces are left.
    """
    out: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0

    def put(room: int, group: tuple[int, int]) -> None:
        if room and group[1]:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append(group)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        rank, n = 0, counts[length]
        while n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, number = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
                take = min(n, number)
                out.append((length, rank, take, first, capacity - room))
                put(room - length, (first, take))
                put(room, (first + take, number - take))
                rank, n = rank + take, n - take
                continue
            each = capacity // length
            for slots, number in ((each, n // each), (n % each, 1)):
                if not slots or not number:
                    continue
                for i in range(slots):
                    out.append((length, rank, number, opened, i * length))
                    rank += number
                put(capacity - slots * length, (opened, number))
                opened += number
            n = 0
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece; an empty table gives an empty one.

    Pieces are written to the shared folder, so that their ranks stay as they are when an
    executor is lost. The plan is broadcast: it has as many rows as lengths and splits, which
    capacity bounds and the number of documents does not.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id))
    tasks = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = tasks.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {x["length"]: x["n"] for x in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "length long, first_rank long, number long, first_sequence long, offset long")
    ranked = cut.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("within"))
    here = (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number"))
    return ranked.join(F.broadcast(slots), here).select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
