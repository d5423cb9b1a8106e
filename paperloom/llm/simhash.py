"""SimHash near-duplicates by deletion-variant signatures.

``near_duplicates`` links fingerprints of a text's shingles that differ in few bits. Texts with
a given Jaccard similarity of shingles are found by ``similar``: at 0.8 fingerprints of
five-word shingles differ in nine of 64 bits, too many to index, those of the distinct words in
four. So each text gets some fingerprints of its words, with different seeds; texts that are
near in any of them are candidates, verified by the exact similarity.

Fingerprints that differ in at most ``bits`` bits are cut into bits // 2 + 1 segments, so that
in one segment they differ in at most one bit. Each fingerprint is indexed under every segment
as it is, and under every segment with one bit made a wildcard. Equal keys are joined and
verified. Under a wildcard only fingerprints with different values of that bit are compared, as
those with the same value meet under the segment as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import bounded_batches, drop_stored, give_back, in_arrow, join_spread, stored
from .graph import components

SEED = 42
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 15
#: Fingerprints under one key that a task compares at once; a key with more is dealt out by pairs of blocks.
BLOCK = 1000
#: Fingerprints whose variants one task makes on average: some 70 rows each.
EXPLODED = 1 << 14
#: Fingerprints of a text's words, how many of them are indexed at once, and the bits in which those of similar texts may differ in all: a sixth.
TABLES, AT_ONCE = 6, 3
APART = 64 * TABLES // 6
_SEEDS = np.random.default_rng(SEED).integers(1, 1 << 63, TABLES).astype(np.uint64)


def _fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(len(words) - shingle + 1, 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _AT_ONCE):
        ones += np.unpackbits(hashes[k : k + _AT_ONCE].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): the bits of the unsigned fingerprint. A text without words, or null, has fingerprint zero."""

    def begin():
        return lambda batch: {"doc_id": batch.column("doc_id"), "fp": [_fingerprint(x, shingle) for x in batch.column("text").to_pylist()]}

    return in_arrow(docs.select("doc_id", "text"), begin, "doc_id long, fp long")


def variants(fps: DataFrame, bits: int) -> DataFrame:
    """(key, side, fp): the keys of each (t, fp), t being above the lowest 32 bits. side: the wildcard's bit, or 2 under a whole segment."""
    segments = bits // 2 + 1
    cuts = [64 * k // segments for k in range(segments + 1)]
    rows = []
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        tag = lambda n: F.lit(n << (max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True))))
        rows.append(F.struct(tag(64 + k).bitwiseOR(part).alias("key"), F.lit(2).cast("byte").alias("side")))
        for b in range(high - low):
            key = tag(low + b).bitwiseOR(part.bitwiseAND(F.lit(((1 << (high - low)) - 1) & ~(1 << b))))
            rows.append(F.struct(key.alias("key"), F.shiftrightunsigned(part, b).bitwiseAND(F.lit(1)).cast("byte").alias("side")))
    keyed = fps.select("t", "fp", F.explode(F.array(*rows)).alias("v"))
    return keyed.select(F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.col("v.key").cast("long")).alias("key"), "v.side", "fp")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as (a, b), at most one for each of n vertices."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            deeper = new[new]
            if (deeper == new).all():
                break
            new = deeper
        new = new[root]
        if (new == root).all():
            child = np.flatnonzero(root != np.arange(n))
            return child, root[child]
        root = new


def _near(group: np.ndarray, side: np.ndarray, own: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of consecutive rows, as a forest. own: the block of a row if the group is a pair of different blocks, else -1."""
    a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, lag, held = np.arange(len(fp)), 0, 0
    while len(at):
        lag += 1
        at = at[at + lag < len(fp)]
        at = at[group[at] == group[at + lag]]
        to = at + lag
        near = np.bitwise_count(fp[at] ^ fp[to]) <= bits
        near &= (side[at] == 2) | (side[at] != side[to])
        near &= (own[at] < 0) | (own[at] != own[to])
        a_all.append(at[near])
        b_all.append(to[near])
        held += int(near.sum())
        if held > 1 << 20:
            a, b = _forest(np.concatenate(a_all), np.concatenate(b_all), len(fp))
            a_all, b_all, held = [a], [b], 0
    return _forest(np.concatenate(a_all), np.concatenate(b_all), len(fp))


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(t, a, b): pairs of the distinct (t, fp) with one t that differ in at most ``bits`` bits; enough of them to have all components. Empty input gives none.

    Groups under a key are compared in numpy and only a forest of their links leaves a task. A
    key with over BLOCK fingerprints is cut into blocks by hash, and each pair of blocks is a
    group of its own, so that tasks stay small and no pair is left out.
    """
    spark = fps.sparkSession
    # a small table has few files, but its variants are many: they are made, and counted, in tasks of even size
    keyed = variants(fps.repartition(fps.count() // EXPLODED + 1, "t", "fp"), bits)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    hot = stored(hot)
    cold = keyed.join(hot, "key", "left_anti").select("key", "side", "fp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("own"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = keyed.join(hot, "key").withColumn("b", block).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("key", "side", "fp", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), F.when(F.col("b") != F.col("c"), F.col("b")).otherwise(-1).alias("own"))
    # a row of block b is in (b, c) with c <> b as b's, and in (b, b) alone
    dealt = cold.union(pairs).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(6)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            key, i, j = now[0], now[3], now[4]
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield from done([x[:cut] for x in now])
        if rest is not None:
            yield from done(rest)
        batch = now = rest = None
        give_back()

    def done(now: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, side, fp, i, j, own = now
        change = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        group = np.concatenate(([0], np.cumsum(change)))
        a, b = _near(group, side, own, fp.view(np.uint64), bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(key[a] >> 32), pa.array(fp[a]), pa.array(fp[b])], names=["t", "a", "b"])

    bounded_batches(spark)
    return dealt.mapInArrow(run, "t long, a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links lead to, its own included.

    Texts without words, null ones too, share fingerprint zero and so one component. Equal
    rows are one vertex and come out as often as they went in. Rows with a null doc_id link
    nothing and have no component_id. An empty table gives an empty one. Columns but doc_id
    and text are left out.
    """
    held = stored(fingerprints(docs, shingle))
    reps = stored(held.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    joined = components(_linked(reps.select(F.lit(0).cast("long").alias("t"), "fp", "rep"), bits))
    classes = reps.join(joined, reps["rep"] == joined["u"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = join_spread(held, classes, ["fp"], "n", held.count(), "doc_id", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _linked(reps: DataFrame, bits: int) -> DataFrame:
    """(u, v): the links of the distinct (t, fp), by the ``rep`` of each."""
    found = links(reps.select("t", "fp"), bits)
    named = lambda end, to: reps.select("t", F.col("fp").alias(end), F.col("rep").alias(to))
    return found.join(named("a", "u"), ["t", "a"]).join(named("b", "v"), ["t", "b"]).select("u", "v")


def _word_fingerprints(text: str | None) -> np.ndarray:
    """TABLES fingerprints of the distinct words; all zero without words."""
    words = {*(text or "").encode().lower().split()}
    if not words:
        return np.zeros(TABLES, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ones = np.zeros((TABLES, 64), np.int64)
    for k in range(0, len(hashes), _AT_ONCE):
        x = hashes[k : k + _AT_ONCE] ^ _SEEDS[:, None]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(TABLES, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(words), axis=1, bitorder="little").view("<i8")[:, 0]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, name, fps): a hash of the set of shingles, and the fingerprints of the words."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            return {"doc_id": batch.column("doc_id"), "name": [jaccard.named(jaccard.shingles(x, shingle)) for x in texts], "fps": [_word_fingerprints(x) for x in texts]}

        return step

    return in_arrow(docs.select("doc_id", "text"), begin, "doc_id long, name long, fps array<long>")


def similar(docs: DataFrame, shingle: int = 5, least: float = 0.8, bits: int = 4) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id that links lead to, its own included.

    Links are pairs of texts with a Jaccard similarity of shingles of ``least`` or more; equal
    sets of shingles always are. Others are found if some path of fingerprints within ``bits``
    of each other leads from one to the other, in any of TABLES tables. Texts without words,
    null ones too, are one component. Rows with a null doc_id link nothing and have no
    component_id. Repeated rows come out as often as they went in. An empty table gives an
    empty one. Columns but doc_id and text are left out.
    """
    held = stored(signatures(docs, shingle))
    named = held.where("doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("u"), F.any_value("fps").alias("fps"), F.count("*").alias("n"))
    reps = stored(named)
    total, edges = reps.count(), []
    for first in range(0, TABLES, AT_ONCE):
        fps = reps.select("u", F.posexplode(F.slice("fps", first + 1, AT_ONCE)).alias("t", "fp")).select("u", F.col("t").cast("long").alias("t"), "fp")
        here = stored(fps.groupBy("t", "fp").agg(F.min("u").alias("rep"), F.count("*").alias("n")))
        equal = join_spread(fps, here.where("n > 1"), ["t", "fp"], "n", AT_ONCE * total, "u").select("u", F.col("rep").alias("v")).where("u <> v")
        edges.append(stored(equal.union(_linked(here.select("t", "fp", "rep"), bits))))
        drop_stored(here)
    union = edges[0]
    for x in edges[1:]:
        union = union.union(x)
    near = components(union)
    heads = near.select(F.col("component").alias("u"), "component").distinct()
    members = stored(near.unionByName(heads).join(reps.select("u", "name", "fps"), "u"))
    joined = components(jaccard.links(members, docs, shingle, least, APART))
    classes = reps.select("name", "u", "n").join(joined, "u", "left").select("name", "n", F.coalesce("component", "u").alias("component_id"))
    out = join_spread(held.select("doc_id", "name"), classes, ["name"], "n", held.count(), "doc_id", "left")
    drop_stored(*edges, members)
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, bits: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component of ``similar``; of rows with one doc_id one stays, those with a null doc_id all stay."""
    found = similar(docs, shingle, least, bits).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where("doc_id is not null").join(found, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
