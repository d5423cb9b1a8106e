"""Token ids in files of Simple-8b words.

A word's upper four bits select how many ids it holds and of how many bits; the rest are the
ids, the first in the lowest bits. Selector 0 is an escape: the next word is one id of up to
64 bits. Ids are coded in blocks of BLOCK, each beginning a new word, and a file lists where
each block begins, so that blocks (and a document's ids) can be decoded at once or alone.

File: MAGIC, then eight-byte little-endian integers: numbers of documents, ids and words;
doc_ids, 1 for each that is null, first ids of documents and the end; first words of blocks
and the end; the words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, in_arrow, new_task, shared_dir, slices, stored
from .tokens import with_end, worker_encoder

MAGIC = b"S8B\x00\x00\x00\x00\x01"
BLOCK = 256
#: Ids after which a writer begins the next file.
FILE_IDS = 4 << 20
#: Ids that a word holds, and the bits of each, by selector; selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _widths(ids: np.ndarray) -> np.ndarray:
    """The least bits of a selector that each id fits."""
    levels = np.unique(BITS)
    return levels[np.searchsorted(np.array([(1 << int(b)) - 1 for b in levels], np.uint64), ids)].astype(np.uint8)


_SMALL = _widths(np.arange(1 << 16, dtype=np.uint64))


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and each block's first word (one more than blocks)."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    width = _SMALL[ids.astype(np.int64)] if n and ids.max() < 1 << 16 else _widths(ids)
    room = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.uint16)
    best = np.zeros(n, np.uint8)
    # a word of fewer bits holds more ids, so where it fits all words of more bits do: the places that are left get fewer
    at = np.arange(n)
    most, span = width, 1  # the widest of the next ``span`` ids
    for s in range(15, 1, -1):
        count = int(COUNTS[s])
        while 2 * span <= count:
            most = np.concatenate((np.maximum(most[:-span], most[span:]), most[-span:]))[:n] if span < n else most
            span *= 2
        at = at[(room[at] >= count) & (most[at] <= BITS[s])]
        at = at[most[np.minimum(at + count - span, n - 1)] <= BITS[s]] if count > span else at
        if not len(at):
            break
        best[at] = s
    if len(at):
        zeros = at[room[at] >= COUNTS[1]]
        behind = np.concatenate(([0], np.cumsum(ids != 0)))
        best[zeros[behind[zeros + COUNTS[1]] == behind[zeros]]] = 1
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    found = []
    while len(at):
        found.append(at)
        at = at + COUNTS[best[at]]
        on = at < ends
        at, ends = at[on], ends[on]
    starts = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    selectors = best[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(selectors == 0)))[:-1]  # escapes take two words
    words = np.zeros(len(starts) + int((selectors == 0).sum()), np.uint64)
    for s in np.unique(selectors):
        here = np.flatnonzero(selectors == s)
        if s == 0:
            words[place[here] + 1] = ids[starts[here]]
            continue
        value = np.full(len(here), np.uint64(int(s) << 60))
        if BITS[s]:
            for k in range(COUNTS[s]):
                value |= ids[starts[here] + k] << np.uint64(k * BITS[s])
        words[place[here]] = value
    firsts = np.searchsorted(starts, np.arange(0, n, BLOCK))
    return words, np.append(place[firsts] if n else np.zeros(0, np.int64), len(words))


def decode(words: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The ids of blocks whose words lie one after another; blocks: their first words and the end."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # a word after an escape is raw: in a run of words with selector 0 every second one, from the first that isn't raw itself
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selectors == 0):
        if not raw[at]:
            raw[at + 1] = True
    counts = np.where(raw, 0, COUNTS[selectors])
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selectors[~raw]):
        here = np.flatnonzero((selectors == s) & ~raw)
        if s == 0:
            out[starts[here]] = words[here + 1]
        elif BITS[s]:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for k in range(COUNTS[s]):
                out[starts[here] + k] = words[here] >> np.uint64(k * BITS[s]) & mask
    return out


def pack_file(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> bytes:
    words, blocks = encode(ids)
    null = np.array([x is None for x in doc_ids], "<i8")
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    head = np.array([len(doc_ids), len(ids), len(words)], "<i8")
    return b"".join([MAGIC, *(x.astype("<i8").tobytes() for x in (head, numbers, null, bounds, blocks)), words.astype("<u8").tobytes()])


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, all ids and where each document's begin."""
    if data[:8] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    n_docs, n_ids, n_words = np.frombuffer(data, "<i8", 3, 8).tolist()
    n_blocks, at, parts = -(-n_ids // BLOCK), 32, []
    for n in (n_docs, n_docs, n_docs + 1, n_blocks + 1):
        parts.append(np.frombuffer(data, "<i8", n, at))
        at += 8 * n
    numbers, null, bounds, blocks = parts
    ids = decode(np.frombuffer(data, "<u8", n_words, at), blocks)
    return [None if x else int(i) for i, x in zip(numbers, null, strict=True)], ids, bounds


def document_ids(data: bytes, k: int) -> np.ndarray:
    """The ids of the file's k-th document, from its blocks alone."""
    n_docs, n_ids, n_words = np.frombuffer(data, "<i8", 3, 8).tolist()
    bounds = np.frombuffer(data, "<i8", n_docs + 1, 32 + 16 * n_docs)
    blocks = np.frombuffer(data, "<i8", -(-n_ids // BLOCK) + 1, 40 + 24 * n_docs)
    words = np.frombuffer(data, "<u8", n_words, len(data) - 8 * n_words)
    a, b = int(bounds[k]), int(bounds[k + 1])
    low, high = a // BLOCK, -(-b // BLOCK)
    found = decode(words[blocks[low] : blocks[high]], blocks[low : high + 1] - blocks[low])
    return found[a - low * BLOCK : b - low * BLOCK]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` in ascending doc_id order (null first) to token files in folder ``path``, which all executors must share.

    Returns the manifest (file, n_docs, n_ids, base), base being the ids of all files before;
    it is kept as a table beside them. A file appears under its name only when it is whole, and
    a task that runs again writes the same files, so lost executors do no harm. Null text
    counts as empty; each document has ``end_id`` after its ids. An empty table gives no file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, k = new_task(lambda: worker_encoder(tokenizer_path)), TaskContext.get().partitionId(), 0
        store, folder = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        store.create_dir(folder, recursive=True)
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        ends = [np.zeros(1, np.int64)]

        def flush() -> pa.RecordBatch:
            nonlocal k, doc_ids, parts, ends
            name = f"part-{task:06d}-{k:06d}.s8b"
            ids = np.concatenate(parts)
            with store.open_output_stream(at := f"{folder}/.{name}.{uuid.uuid4().hex}") as file:
                file.write(pack_file(doc_ids, ids, np.concatenate(ends)))
            store.move(at, f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})
            k, doc_ids, parts, ends = k + 1, [], [], [np.zeros(1, np.int64)]
            return row

        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = with_end(*encoder.encode(part.column("text")), end_id)
                doc_ids += part.column("doc_id").to_pylist()
                parts.append(ids)
                ends.append(bounds[1:] + ends[-1][-1])
                if ends[-1][-1] >= FILE_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(ordered.mapInArrow(run, "file string, n_docs long, n_ids long"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>) of each document in the files; start counts the ids of all documents before it."""
    return _read(manifest, path, "doc_id long, start long, n_tokens long, ids array<long>", lambda ids, bounds: {"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))})


def read_digests(manifest: DataFrame, path: str) -> DataFrame:
    """``read`` with each document's crc32 of ids (as unsigned 32-bit integers) instead of the ids."""

    def crc(ids: np.ndarray, bounds: np.ndarray) -> dict:
        data = memoryview(ids.astype("<u4")).cast("B")
        return {"ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]}

    return _read(manifest, path, "doc_id long, start long, n_tokens long, ids_crc32 long", crc)


def _read(manifest: DataFrame, path: str, schema: str, more) -> DataFrame:
    def begin():
        store, folder = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")

        def step(batch: pa.RecordBatch) -> dict:
            doc_ids, parts, ends, starts = [], [], [np.zeros(1, np.int64)], []
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_stream(f"{folder}/{name}") as file:
                    numbers, ids, bounds = unpack_file(file.read())
                doc_ids += numbers
                parts.append(ids)
                ends.append(bounds[1:] + ends[-1][-1])
                starts.append(bounds[:-1] + base)
            bounds = np.concatenate(ends)
            return {"doc_id": doc_ids, "start": np.concatenate(starts), "n_tokens": np.diff(bounds), **more(np.concatenate(parts), bounds)}

        return step

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return in_arrow(manifest.select("file", "base").repartition(n, "file"), begin, schema, weigh="file")


def written(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, str]:
    """``write`` into a new folder of the shared one: the manifest and the folder."""
    path = shared_dir(docs.sparkSession)
    return write(docs, path, tokenizer_path, end_id), path
