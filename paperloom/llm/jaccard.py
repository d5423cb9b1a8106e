"""Exact Jaccard similarity of word shingles, by which candidates for near-duplicates are verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Texts of a component that a task compares at once; a component with more is dealt out by pairs of blocks.
BLOCK = 400


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending: lower-cased words, of fewer than ``shingle`` words all; none without words."""
    words = (text or "").encode().lower().split()  # of bytes, as in simhash
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(len(words) - shingle + 1, 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def named(found: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(found.tobytes()), "<i8")[0])


def _similar(sets: list[np.ndarray], fps: np.ndarray, own: np.ndarray, least: float, apart: int) -> list[tuple[int, int]]:
    """Links of all components of the pairs of similarity ``least``; own: the block of a set if two blocks are compared, else -1.

    Pairs whose fingerprints differ in over ``apart`` bits are not compared.
    """
    size = np.array([len(x) for x in sets], np.int64)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate(([0], np.cumsum(size)))
    root, links = np.arange(len(sets)), []
    mark = np.zeros(int(number.max(initial=-1)) + 1, bool)
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[(root[j] != root[i]) & ((own[i] < 0) | (own[j] != own[i]))]
        j = j[np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i])]
        j = j[np.bitwise_count(fps[j] ^ fps[i]).sum(axis=1, dtype=np.int64) <= apart]
        if not len(j):
            continue
        mine = number[bounds[i] : bounds[i + 1]]
        mark[mine] = True
        at = np.concatenate([number[bounds[k] : bounds[k + 1]] for k in j])
        both = np.add.reduceat(mark[at], np.cumsum(size[j]) - size[j], dtype=np.int64) if len(at) else np.zeros(len(j), np.int64)
        mark[mine] = False
        # whole numbers are divided, so 4 of 5 is 0.8 exactly
        for k in j[both / np.maximum(size[j] + size[i] - both, 1) >= least].tolist():
            if root[k] != root[i]:
                links.append((i, k))
                root[root == root[k]] = root[i]
    return links


def links(members: DataFrame, docs: DataFrame, shingle: int, least: float, apart: int) -> DataFrame:
    """(u, v): pairs of (component, u, name, fps) in one component whose texts have a similarity of ``least``; enough of them to have all components.

    A component with over BLOCK members is cut into blocks by hash, and each pair of blocks is
    a group of its own, so that tasks stay small and no pair is left out.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.when(F.col("b") != F.col("c"), F.col("b")).otherwise(-1)
    # a row of block b is in (b, c) with c <> b as b's, and in (b, b) alone
    dealt = dealt.select("component", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "u", "name", "fps", own.alias("own"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("u"), "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("u")
        found = [shingles(x, shingle) for x in table.column("text").to_pylist()]
        names = table.column("name").to_pylist()
        # a doc_id's other texts are not meant; equal rows link to themselves
        on = [k for k, x in enumerate(found) if named(x) == names[k]]
        u, own = table.column("u").to_numpy()[on], table.column("own").to_numpy()[on]
        fps = np.array(table.column("fps").to_pylist(), np.int64).view(np.uint64)[on]
        pairs = np.array(_similar([found[k] for k in on], fps, own, least, apart), np.int64).reshape(-1, 2)
        return pa.table({"u": u[pairs[:, 0]], "v": u[pairs[:, 1]]})

    bounded_batches(docs.sparkSession)
    return dealt.join(texts, "u").groupBy("component", "i", "j").applyInArrow(compare, "u long, v long")
