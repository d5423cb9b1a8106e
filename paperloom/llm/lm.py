"""Stupid-backoff scores, computed relationally.

Documents are gathered into blocks. A block's n-grams are exploded, counted and dealt out by
hash; each hash range is a partition of the count tables, where the blocks' counts are summed
and joined back to the blocks' n-grams. A block's answers meet it again, and each document's
terms are summed. From order three on only n-grams whose two parts other documents have are
dealt out, as no other document can have the rest. A document is scored by all others: its own n-grams are taken off
the counts. Rows of these tables are sorted runs of n-grams, coded by their differences, so
that a hash that many documents have is one entry for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .common import in_arrow, stored

#: Bytes of text in a block, and n-grams of all blocks that a partition of the count tables gets on average at most.
BLOCK_BYTES, BUCKET_GRAMS = 6 << 20, 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Grams:
    """A block's n-grams of one order: the tokens that end one, which n-gram each ends, and the distinct ones' hashes and counts."""

    def __init__(self, at: np.ndarray, which: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
        self.at, self.which, self.hashes, self.counts = at, which, hashes, counts
        self.order = np.argsort(hashes)  # by hash, as they are dealt out


def block_grams(token: np.ndarray, doc: np.ndarray, word_hash: np.ndarray, order: int) -> list[Grams]:
    """n-grams of orders 1 to ``order`` within documents; tokens are numbers of words."""
    n_words = np.int64(max(len(word_hash), 1))
    out = [Grams(np.arange(len(token)), token, _mixed(word_hash), np.bincount(token, minlength=len(word_hash)))]
    place = np.arange(len(token))
    for n in range(2, order + 1):
        at = place[n - 1 :]
        at = at[doc[at] == doc[at - n + 1]]
        shorter = out[-1]
        before = np.zeros(len(token), np.int64)
        before[shorter.at] = shorter.which
        keys, which, counts = np.unique(before[at - 1] * n_words + token[at], return_inverse=True, return_counts=True)
        hashes = _mixed(shorter.hashes[keys // n_words] * _ODD + word_hash[keys % n_words] + np.uint64(n))
        out.append(Grams(at, which, hashes, counts))
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, lengths, words, tokens, n): the documents as numbers of the block's distinct words, and those words' hashes."""

    def begin():
        task, made = TaskContext.get().partitionId(), 0

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal made
            numbers: dict[bytes, int] = {}
            tokens: list[int] = []
            lengths = []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().lower().split()
                tokens += [numbers.setdefault(w, len(numbers)) for w in words]
                lengths.append(len(words))
            made += 1
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
            return {"block": [task << 32 | made], "doc_ids": [batch.column("doc_id").to_pylist()], "lengths": [lengths], "words": [runs.packed(hashes, 8)], "tokens": [runs.packed(np.array(tokens, np.uint64), 4)], "n": [len(tokens)]}

        return step

    return in_arrow(docs.select("doc_id", "text"), begin, "block long, doc_ids array<long>, lengths array<int>, words binary, tokens binary, n long", step_bytes=BLOCK_BYTES)


def _grams_of(row: dict, order: int) -> tuple[np.ndarray, list[Grams]]:
    doc = np.repeat(np.arange(len(row["lengths"])), row["lengths"])
    return doc, block_grams(runs.unpacked(row["tokens"], 4).astype(np.int64), doc, runs.unpacked(row["words"], 8), order)


_COUNTED = "bucket int, block long, n int, grams binary, counts binary"


def _dealt(block: int, n: int, grams: Grams, edges: np.ndarray, some: np.ndarray | None, out: dict) -> None:
    """Add to ``out`` a row for each hash range in which the block has n-grams; some: which of the distinct ones."""
    order = grams.order if some is None else grams.order[some[grams.order]]
    hashes, counts = grams.hashes[order], grams.counts[order]
    for bucket, a, b in runs.ranges(hashes, edges):
        for k, x in (("bucket", bucket), ("block", block), ("n", n), ("grams", runs.packed_run(hashes[a:b])), ("counts", runs.packed(counts[a:b], 4))):
            out[k].append(x)


def _empty(schema: str) -> dict:
    return {x.split()[0]: [] for x in schema.split(", ")}


def counted(held: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, n, grams, counts): each block's distinct words and pairs in a hash range, and how often it has them."""
    edges = runs.edges(buckets)

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            out = _empty(_COUNTED)
            for row in batch.to_pylist():
                for n, grams in enumerate(_grams_of(row, 2)[1], 1):
                    _dealt(row["block"], n, grams, edges, None, out)
            return out

        return step

    return in_arrow(held.select("block", "words", "tokens", "lengths"), begin, _COUNTED, weigh="tokens", step_bytes=1)


def _elsewhere(grams: Grams, totals: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each token that ends an n-gram, how often other documents have it. totals: of the distinct n-grams, by their numbers."""
    own = np.ones(len(grams.at), np.int64)
    several = np.flatnonzero(grams.counts[grams.which] > 1)
    key = doc[grams.at[several]] * np.int64(len(grams.counts)) + grams.which[several]
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    own[several] = counts[back]
    return totals[grams.which] - own


def _totals(grams: Grams, answers: list[tuple[int, bytes]], some: np.ndarray | None = None) -> np.ndarray:
    """All blocks' counts of a block's distinct n-grams; those that weren't asked for are in no other document and have the block's own."""
    order = grams.order if some is None else grams.order[some[grams.order]]
    totals = grams.counts.astype(np.int64)
    if len(order):
        totals[order] = np.concatenate([runs.unpacked(x, 8) for _, x in sorted(answers)]).astype(np.int64)
    return totals


def _by_order(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list[tuple[int, bytes]]] = {}
    for n, bucket, totals in zip(*(table.column(k).to_pylist() for k in ("n", "bucket", "totals")), strict=True):
        out.setdefault(n, []).append((bucket, totals))
    return out


def _settled(row: dict, answers: dict[int, list[tuple[int, bytes]]], order: int):
    """The block's n-grams and their counts elsewhere, order by order, as far as there are answers; and which distinct ones of the next order may be elsewhere."""
    doc, grams = _grams_of(row, order)
    others, some = [], None
    for n in range(1, order + 1):
        g = grams[n - 1]
        if n > 2:
            # an n-gram that another document has has both its parts there
            known = np.zeros(len(doc), bool)
            known[grams[n - 2].at] = others[-1] > 0
            here = known[g.at] & known[g.at - 1]
            some = np.zeros(len(g.counts), bool)
            some[g.which[here]] = True
            if n not in answers and some.any():
                return doc, grams, others, some
        others.append(_elsewhere(g, _totals(g, answers.get(n, []), some), doc))
    return doc, grams, others, None


def counted_next(held: DataFrame, answers: DataFrame, order: int, buckets: int) -> DataFrame:
    """As ``counted``, for n-grams of one order above those answered: only those whose parts other documents have."""
    edges = runs.edges(buckets)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out, found = _empty(_COUNTED), _by_order(right)
        for row in left.to_pylist():
            _, grams, _, some = _settled(row, found, order)
            if some is not None:
                _dealt(row["block"], order, grams[order - 1], edges, some, out)
        kinds = {"bucket": pa.int32(), "block": pa.int64(), "n": pa.int32(), "grams": pa.binary(), "counts": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return held.select("block", "words", "tokens", "lengths").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, _COUNTED)


def answered(counts: DataFrame) -> DataFrame:
    """(block, n, bucket, totals): for the n-grams of ``counts``, in their order, how often all blocks together have them. A stored table."""

    def join(table: pa.Table) -> pa.Table:
        totals = runs.summed([runs.unpacked_run(x) for x in table.column("grams").to_pylist()], [runs.unpacked(x, 4) for x in table.column("counts").to_pylist()])
        return pa.table({"block": table.column("block"), "n": table.column("n"), "bucket": table.column("bucket"), "totals": pa.array([runs.packed(x, 8) for x in totals], pa.binary())})

    return stored(counts.groupBy("bucket").applyInArrow(join, "block long, n int, bucket int, totals binary"))


def terms(doc: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's score, and the order that it was found at (0: a word that no other document has).

    others: for each order the positions at which n-grams end and their counts elsewhere.
    total: the number of tokens elsewhere, by token.
    """
    n = len(doc)
    at, count = others[0]
    score = np.log10(np.maximum(count, 1) / np.maximum(total, 1))
    order = (count > 0).astype(np.int64)
    before = np.zeros(n, np.int64)
    before[at] = count
    for k, (at, count) in enumerate(others[1:], 2):
        has = np.zeros(n, bool)
        has[at] = True
        score[has] += np.log10(backoff)  # given back where this order knows the n-gram
        known = count > 0
        here = at[known]
        score[here] = np.log10(count[known] / before[here - 1])
        order[here] = k
        before = np.zeros(n, np.int64)
        before[at] = count
    return score, order


def scores(docs: DataFrame, order: int = 3, backoff: float = 0.4) -> DataFrame:
    """(doc_id, n_words, log10_score, mean_log10, n_found): the sum and mean of the words' log10 scores, and the words found at the highest order.

    Words are stretches of other than ASCII white space, with A-Z lower-cased. A word's score
    is the count of the n-gram that ends with it over that of the n-gram without it, both in
    all other rows, at the highest order that has it, times ``backoff`` for each order that
    hasn't; a word that no other row has counts as one. The first words of a text have shorter
    n-grams only. A text that is null or has no word has score 0 and mean null. Repeated rows
    are others to each other; a null doc_id stays null; an empty table gives an empty one.

    Work and shuffled bytes grow with the number of words; a partition of the count tables has
    about BUCKET_GRAMS entries, however frequent an n-gram is. The rows of ``counted`` are
    blocks times buckets.
    """
    spark = docs.sparkSession
    held = stored(blocks(docs))
    n_all = held.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-2 * n_all // BUCKET_GRAMS))
    answers = answered(counted(held, buckets))
    for n in range(3, order + 1):
        answers = answers.union(answered(counted_next(held, answers, n, buckets)))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "log10_score": [], "mean_log10": [], "n_found": []}
        found = _by_order(right)
        for row in left.to_pylist():
            lengths = row["lengths"]
            doc, grams, others, _ = _settled(row, found, order)
            size = np.array(lengths, np.int64)
            score, level = terms(doc, [(g.at, x) for g, x in zip(grams, others, strict=True)], n_all - size[doc], backoff)
            sums = np.bincount(doc, score, len(size))
            out["doc_id"] += row["doc_ids"]
            out["n_words"] += lengths
            out["log10_score"] += sums.tolist()
            out["mean_log10"] += [s / n if n else None for s, n in zip(sums.tolist(), lengths, strict=True)]
            out["n_found"] += np.bincount(doc, level == order, len(size)).astype(np.int64).tolist()
        return pa.table({k: pa.array(v, pa.int64() if k in ("doc_id", "n_words", "n_found") else pa.float64()) for k, v in out.items()})

    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, "doc_id long, n_words long, log10_score double, mean_log10 double, n_found long")
