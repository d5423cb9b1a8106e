"""Repeated passages by a distributed difference-cover suffix array.

The suffixes of all bytes of a corpus are far too many to sort, so the array is built over
phrases. Texts are cut at minimizers: places whose hash of eight bytes is the least of a window,
so that equal passages are cut alike, and a passage of the given length has a whole phrase in
common with its equal. What surely follows a passage's first cut is its anchor; phrases behind
no repeated anchor can't repeat, and the runs of the others are the strings. Their suffixes are sorted by the difference-cover algorithm: triples at two of
three positions are sorted and named, the strings of names are sorted by recursion, and the
remaining suffixes are merged with them. Neighbours in the array are then compared, which gives
at each phrase how far it repeats.

Phrases settle all but the two ends of a passage, less than a window each. Of the few positions
left there, and of those that may equal one of them elsewhere, hashes of the whole length are
counted, which makes the result exact.

Names and hashes are of 64 bits: two different passages are taken for equal with a chance of
about n * n / 2^65 over n of them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import runs
from .common import bounded_batches, byte_rows, drop_stored, give_back, in_arrow, join_spread, ragged, stored, worker_held

_GRAM = 8
_BASE = np.uint64(0xD1342543DE82EF95)
#: Recursion ends below so many positions, whatever the input's size: they are sorted in one task.
SMALL = 1000
#: Cuts of the texts whose strings are one row.
BLOCK_CUTS = 1 << 14
#: Characters that stand for a word, six bits each, and words whose characters a worker remembers.
_CODE, _REMEMBERED = 6, 100_000
#: Bytes of texts with repeated phrases whose open places one hash range gets on average at most.
BUCKET_BYTES = 16 << 20
#: Neighbours in the array that are compared in one task.
ADJACENT = 1 << 12


def _window(length: int) -> int:
    """The widest minimizer window of which two fit a passage without meeting in one place."""
    return (length - _GRAM + 1) // 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the eight bytes from each byte; zeros follow the end."""
    pad = np.concatenate((data, np.zeros(_GRAM, np.uint8)))
    return _mixed(np.ndarray((len(data),), "<u8", pad, 0, (1,)).astype(np.uint64))


def cuts(data: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some window of ``window`` places within a row; the leftmost of equal ones."""
    n = len(data)
    if n < window + _GRAM:
        return np.zeros(0, np.int64)
    # windows whose last place still has its eight bytes in the row
    size = np.diff(bounds)
    starts = ragged(bounds[:-1], np.maximum(size - (window + _GRAM - 2), 0))
    chosen = np.zeros(n, bool)
    chosen[_leasts(data, window)[starts]] = True
    return np.flatnonzero(chosen)


def phrases(docs: DataFrame, length: int, read: Callable | None = None) -> DataFrame:
    """(doc_id, text_hash, n_bytes, sha256, cuts, names, anchors): a row for each document.

    names are hashes of the phrases between cuts, of 63 bits. anchors are hashes of the bytes after a cut
    that a repeated passage surely has behind its first cut; 0 where the text ends before.
    ``read``, if given, turns a list of texts into the strings to take for them.
    """
    window = _window(length)
    ahead = length - window + 1

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            column = batch.column("text")
            data, bounds = byte_rows(pa.array(read(column.to_pylist()), pa.string()) if read else column)
            raw, at = data.tobytes(), cuts(data, bounds, window)
            row = np.searchsorted(bounds, at, side="right") - 1
            first = np.searchsorted(at, bounds)  # each row's first cut
            names = np.zeros(len(at), np.int64)
            inner = np.flatnonzero(row[:-1] == row[1:]) if len(at) else np.zeros(0, np.int64)
            names[inner] = [xxhash.xxh3_64_intdigest(raw[a:b]) >> 1 for a, b in zip(at[inner].tolist(), at[inner + 1].tolist(), strict=True)]
            anchors = np.zeros(len(at), np.int64)
            long_ = np.flatnonzero(at + ahead <= bounds[row + 1])
            anchors[long_] = _anchors(raw, at[long_], ahead)
            counts = np.diff(first)
            texts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            named = np.ones(len(at), bool)
            named[first[1:][counts > 0] - 1] = False  # what follows a row's last cut is no phrase
            return {
                "doc_id": batch.column("doc_id"),
                "text_hash": [xxhash.xxh3_128_digest(x) for x in texts],
                "n_bytes": np.diff(bounds),
                "sha256": [hashlib.sha256(x).hexdigest() for x in texts],
                "cuts": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at - bounds[row], pa.int32())),
                "names": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(named)))[first], pa.int32()), pa.array(names[named])),
                "anchors": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(anchors)),
            }

        return step

    return in_arrow(docs.select("doc_id", "text"), begin, "doc_id long, text_hash binary, n_bytes long, sha256 string, cuts array<int>, names array<long>, anchors array<long>")


# --- the suffix array ------------------------------------------------------------------------
#
# Strings are held in blocks, a row for many: ``values`` are their symbols one after another,
# ``firsts`` the places at which they begin, ``longest`` the greatest of their lengths.

STRINGS = "firsts array<int>, values array<long>, longest int"


def _grouped(rows: DataFrame, schema: str, whole: Callable[[dict], dict]) -> DataFrame:
    """``rows``, ordered within their block's partition, handed to ``whole`` as columns, never with a part of a block: it returns columns by name."""
    names, out = rows.columns, pa.schema([(f.name, to_arrow_type(f.dataType)) for f in rows.sparkSession.createDataFrame([], schema).schema])

    def batch_of(parts: dict) -> pa.RecordBatch:
        found = whole(parts)
        return pa.RecordBatch.from_arrays([x if isinstance(x := found[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the rows of a block that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {k: batch.column(k).to_numpy() for k in names}
            if rest is not None:
                now = {k: np.concatenate((rest[k], x)) for k, x in now.items()}
            cut = int(np.searchsorted(now["block"], now["block"][-1]))
            rest = {k: x[cut:] for k, x in now.items()}
            if cut:
                yield batch_of({k: x[:cut] for k, x in now.items()})
        if rest is not None:
            yield batch_of(rest)
        batch = now = rest = None
        give_back()

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(collect, schema)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where consecutive rows differ from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _as_lists(first: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), pa.array(values))


def _strings(block: np.ndarray, heads: np.ndarray, values: np.ndarray) -> dict:
    """Columns of blocks of strings, of rows ordered by block; ``heads``: where strings begin."""
    first = _firsts(block)
    lists = np.searchsorted(heads, np.append(first, len(block)))
    longest = np.maximum.reduceat(np.diff(np.append(heads, len(block))), lists[:-1])
    within = heads - np.repeat(first, np.diff(lists))
    firsts = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(within, pa.int32()))
    return {"block": block[first], "firsts": firsts, "values": _as_lists(first, values), "longest": longest}


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of lists."""
    at = np.asarray(column.offsets).astype(np.int64)
    return at - at[0], column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


class _Flat:
    """A batch of blocks of strings: of all places the row, the place in it, the string, the place in that, the end of that, and the symbol."""

    def __init__(self, batch: pa.RecordBatch):
        self.bounds, self.values = _lists(batch.column("values"))
        lists, firsts = _lists(batch.column("firsts"))
        start = firsts + np.repeat(self.bounds[:-1], np.diff(lists))
        size = np.diff(np.append(start, len(self.values)))
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(self.bounds))
        self.string = np.repeat(np.arange(len(start)), size)
        self.place = np.arange(len(self.values)) - self.bounds[self.row]
        self.j = np.arange(len(self.values)) - start[self.string]
        self.end = (start + size)[self.string]
        self.block = np.asarray(batch.column("block"))[self.row]

    def ahead(self, values: np.ndarray, k: int) -> np.ndarray:
        """The value ``k`` places on in the same string; -1 beyond its end."""
        at = np.arange(len(values)) + k
        return np.where(at < self.end, values[np.minimum(at, len(values) - 1)], -1) if len(values) else values

    def samples(self) -> np.ndarray:
        """The places at 1 and 2 modulo 3, of each string those at 1 before those at 2: the strings of the next level."""
        on = np.flatnonzero(self.j % 3)
        return on[np.argsort(self.string[on] * 2 + self.j[on] % 3, kind="stable")]


def _ranked(rows: DataFrame, keys: list[str], answers: list[list[int]]) -> DataFrame:
    """(block, place, rank) of (block, place, own, kind, <keys>), all long but int kind: own and how many rows have lesser keys, of the kinds in answers[kind].

    Rows are sorted over the whole cluster, by place among equal keys, so that a frequent key
    spreads over tasks. Each task counts from its own first row; one row for each task comes
    to the driver, which adds what stands before. A stored table.
    """
    wanted = np.zeros((len(answers), len(answers)), np.int64)
    for kind, counted in enumerate(answers):
        wanted[kind, counted] = 1
    out = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("rank", pa.int64()), ("slot", pa.int32()), ("task", pa.string())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        total = before = np.zeros(len(answers), np.int64)
        first = last = None
        groups = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(k).to_numpy() for k in keys]
            kind = batch.column("kind").to_numpy()
            new = np.zeros(len(kind), bool)
            new[_firsts(*key)] = True
            head = [int(k[0]) for k in key]
            new[0] = head != last
            first = first or head
            of = kind[:, None] == np.arange(len(answers))
            sums = np.cumsum(of, axis=0) - of + total
            group = np.cumsum(new)
            befores = np.concatenate((before[None], sums[new]))
            rank = batch.column("own").to_numpy() + (befores[group] * wanted[kind]).sum(axis=1)
            # the task's first key may have begun in an earlier one: what stands before that is not known yet
            slot = (task * len(answers) + kind) * 2 + (group + groups == 1)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("place"), pa.array(rank), pa.array(slot, pa.int32()), pa.nulls(len(kind), pa.string())], schema=out)
            total, before, last, groups = total + of.sum(axis=0), befores[-1], [int(k[-1]) for k in key], groups + int(group[-1])
        if first:
            told = json.dumps([task, first, last, groups, before.tolist(), total.tolist()])
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in out][:-1], pa.array([told])], schema=out)

    spark = rows.sparkSession
    bounded_batches(spark)
    ordered = rows.repartitionByRange(*keys, "block", "place").sortWithinPartitions(*keys, "block", "place")
    local = stored(ordered.select("block", "place", "own", "kind", *keys).mapInArrow(count, "block long, place long, rank long, slot int, task string"))
    told = sorted(json.loads(r["task"]) for r in local.where("task is not null").select("task").collect())
    base = here = np.zeros(len(answers), np.int64)
    key, add = None, []
    for task, first, last, groups, before, total in told:
        here = here if first == key else base
        for kind in range(len(answers)):
            slot = (task * len(answers) + kind) * 2
            add += [(slot, int(wanted[kind] @ base)), (slot + 1, int(wanted[kind] @ here))]
        here = base + np.array(before) if groups > 1 else here
        key, base = last, base + np.array(total)
    bases = spark.createDataFrame(add, "slot int, more long")  # two for each task and kind
    found = local.where("task is null").join(F.broadcast(bases), "slot").select("block", "place", (F.col("rank") + F.col("more")).alias("rank"))
    found._stored_at = local._stored_at
    return found


def _back(ranked: DataFrame) -> DataFrame:
    """``ranked`` in its blocks' partitions, ordered by place."""
    return ranked.select("block", "place", "rank").repartition("block").sortWithinPartitions("block", "place")


def _rank_lists(ranked: DataFrame) -> DataFrame:
    """(block, ranks): the ranks of each block's places, in their order; rows of one place are summed."""

    def whole(x: dict) -> dict:
        first = _firsts(x["block"], x["place"])
        block, rank = x["block"][first], np.add.reduceat(x["rank"], first)
        at = _firsts(block)
        return {"block": block[at], "ranks": _as_lists(at, rank)}

    return _grouped(_back(ranked), "block long, ranks array<long>", whole)


_KEYED = "block long, place long, own long, kind int, a long, b long, c long"


def _triples(strings: DataFrame) -> DataFrame:
    """The three symbols from each sample; place: its place on the next level, doubled, and one more where a string begins."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            x = _Flat(batch)
            on = x.samples()
            row = x.row[on]
            q = np.arange(len(on)) - np.searchsorted(row, row)
            out = {"block": x.block[on], "place": 2 * q + (x.j[on] < 3), "own": np.zeros(len(on), np.int64), "kind": np.zeros(len(on), np.int32)}
            return out | {c: x.ahead(x.values, k)[on] for k, c in enumerate("abc")}

        return step

    return in_arrow(strings, begin, _KEYED, weigh=None)


def _below(named: DataFrame) -> DataFrame:
    """The strings of names: of each string the samples at 1 and those at 2 modulo 3."""
    return _grouped(_back(named), f"block long, {STRINGS}", lambda x: _strings(x["block"], np.flatnonzero(x["place"] & 1), x["rank"]))


def _merged(strings: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rows to sort for the merge. Kinds 0 and 1 are places at 0 and 1 modulo 3 by a symbol and the rank behind it, kinds 2 and 3 those at 0 and 2 by two symbols and the rank behind them."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            x = _Flat(batch)
            on = x.samples()
            rank = np.full(len(x.values), -1, np.int64)
            rank[on] = _lists(batch.column("ranks"))[1] if len(on) else []
            cls = x.j % 3
            b, r1, r2 = x.ahead(x.values, 1), x.ahead(rank, 1), x.ahead(rank, 2)
            out: dict = {k: [] for k in ("block", "place", "own", "kind", "tag", "a", "b", "c")}
            for kind, (c, tag) in enumerate(((0, 0), (1, 0), (0, 1), (2, 1))):
                k = np.flatnonzero(cls == c)
                n = np.zeros(len(k), np.int64)
                own = n if c == 0 else rank[k]
                for name, y in (("block", x.block[k]), ("place", x.place[k]), ("own", own), ("kind", n + kind), ("tag", n + tag), ("a", x.values[k]), ("b", b[k] if tag else r1[k]), ("c", r2[k] if tag else n)):
                    out[name].append(y)
            return {k: np.concatenate(v) for k, v in out.items()}

        return step

    return in_arrow(strings.join(ranked, "block", "left"), begin, "block long, place long, own long, kind int, tag long, a long, b long, c long", weigh=None)


def _small_ranks(strings: DataFrame) -> DataFrame:
    """(block, ranks), sorted by doubling in one task; for up to SMALL positions."""

    def sort(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        x = _Flat(batch)
        return pa.table({"block": table.column("block"), "ranks": _as_lists(x.bounds[:-1], _ranks(x.values, x.end))})

    return strings.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: sort(t), "block long, ranks array<long>")


def _count_rank(*keys: np.ndarray) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return out


def _ranks(names: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the number of lesser suffixes; strings end before ``end``, and end is less than all."""
    rank, span, at = _count_rank(names), 1, np.arange(len(names))
    while True:
        inside = at + span < end
        if not inside.any():
            return rank
        nxt = _count_rank(rank, np.where(inside, rank[np.minimum(at + span, len(names) - 1)], -1))
        if (nxt == rank).all():
            return rank
        rank, span = nxt, 2 * span


def suffix_ranks(strings: DataFrame, small: int = SMALL) -> DataFrame:
    """(block, ranks) for blocks of strings (block long, firsts array<int>, values array<long>, longest int); no string is empty.

    A rank is the number of suffixes of all strings that are less; equal suffixes have equal
    ranks. A string's end is less than any symbol. Values are at least 0. An empty table gives
    an empty one. There are at most as many levels as the longest string has digits to base 3.
    """
    strings = strings.select("block", "firsts", "values", "longest")
    total = strings.agg(F.sum(F.size("values")), F.max("longest")).first()
    if (total[0] or 0) <= small:
        return _small_ranks(strings)
    if total[1] == 1:
        single = strings.select("block", F.posexplode("values").alias("place", "a"))
        single = single.select("block", F.col("place").cast("long").alias("place"), F.lit(0).cast("long").alias("own"), F.lit(0).alias("kind"), "a")
        parts = _ranked(single, ["a"], [[0]])
        out = stored(_rank_lists(parts))
        drop_stored(parts)
        return out
    # 1. sort and name the triples at positions 1 and 2 modulo 3; 2. sort the strings of names
    named = _ranked(_triples(strings), ["a", "b", "c"], [[0]])
    below = stored(_below(named))
    drop_stored(named)
    ranked = suffix_ranks(below, small)
    # 3. merge the rest: they compare with class 1 by a symbol and the rank behind it, with class 2 by two and the rank behind them
    parts = _ranked(_merged(strings, ranked), ["tag", "a", "b", "c"], [[0, 1], [0], [3], [2]])
    out = stored(_rank_lists(parts))
    drop_stored(below, parts, ranked)
    return out


# --- from neighbours to spans ----------------------------------------------------------------


def _text_blocks(texts: DataFrame) -> DataFrame:
    """(block, tids, text_hashes, reps, copies, n_bytes, cuts, names, anchors): a row for texts with about BLOCK_CUTS cuts, a list of each column; tids are new numbers."""

    def begin():
        task, made = TaskContext.get().partitionId(), 0

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal made
            n = batch.num_rows
            each = np.cumsum(pc.list_value_length(batch.column("cuts")).to_numpy()) // BLOCK_CUTS
            first = _firsts(each)
            block = (task << 20) + made + np.arange(len(first))
            made += len(first)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), x)
            size = np.diff(np.append(first, n))
            tids = (np.repeat(block, size) << 16) + np.arange(n) - np.repeat(first, size)  # a batch has 20,000 rows at most
            columns = {k: lists(batch.column(c)) for k, c in (("text_hashes", "text_hash"), ("reps", "rep"), ("copies", "copies"), ("n_bytes", "n_bytes"), ("cuts", "cuts"), ("names", "names"), ("anchors", "anchors"))}
            return {"block": block, "tids": lists(pa.array(tids))} | columns

        return step

    schema = "block long, tids array<long>, text_hashes array<binary>, reps array<long>, copies array<long>, n_bytes array<long>, cuts array<array<int>>, names array<array<long>>, anchors array<array<long>>"
    return in_arrow(texts, begin, schema, weigh=None)


def _repeated_anchors(blocks: DataFrame, n_cuts: int) -> DataFrame:
    """(block, again): a block's anchors that occur more than once in all blocks, ascending."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            found = [np.unique(_lists(x.values)[1], return_counts=True) for x in batch.column("anchors")]
            block = np.repeat(np.asarray(batch.column("block")), [len(x) for x, _ in found])
            none = [(np.zeros(0, np.int64),) * 2]
            return {"block": block, "anchor": np.concatenate([x for x, _ in none + found]), "n": np.concatenate([n for _, n in none + found])}

        return step

    there = stored(in_arrow(blocks.select("block", "anchors"), begin, "block long, anchor long, n long", weigh=None).where("anchor <> 0"))
    counts = there.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).where("n > 1").select("anchor", "blocks")
    found = join_spread(there.select("block", "anchor"), counts, ["anchor"], "blocks", n_cuts, "block")
    out = stored(found.groupBy("block").agg(F.array_sort(F.collect_list("anchor")).alias("again")))
    drop_stored(there)
    return out


def _phrases_behind(blocks: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """(block, tid, i, name, start, size): phrases that begin at a cut whose anchor occurs again, or less than ``length`` bytes behind one: no other can be in a repeated passage.

    Short phrases between equal ones are left out: ``_solid`` knows what they would tell.
    """
    window = _window(length)

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            out = {k: [np.zeros(0, np.int64)] for k in ("block", "tid", "i", "name", "start", "size")}
            for block, tids, cuts_, names_, anchors_, again_ in zip(*(batch.column(k) for k in ("block", "tids", "cuts", "names", "anchors", "again")), strict=True):
                bounds, cut = _lists(cuts_.values)
                name, anchor = _lists(names_.values)[1], _lists(anchors_.values)[1]
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                live = np.isin(anchor, again_.values.to_numpy())
                # of each cut the last live one at or before it, in its text
                last = np.maximum.accumulate(np.where(live, np.arange(len(cut)), -1))
                phrase = np.flatnonzero(text[:-1] == text[1:])  # cuts that begin one, in the order of names
                at, of = last[phrase], text[phrase]
                size = cut[phrase + 1] - cut[phrase]
                keep = (at >= bounds[of]) & (cut[phrase] - cut[np.maximum(at, 0)] < length)
                same = np.zeros(len(name) + 1, bool)
                same[1:-1] = (name[1:] == name[:-1]) & (of[1:] == of[:-1])
                keep &= ~(same[:-1] & same[1:] & (size <= window // 4))
                k = np.flatnonzero(keep)
                for key, x in (("block", np.full(len(k), block.as_py())), ("tid", np.asarray(tids.values)[of[k]]), ("i", phrase[k] - bounds[of[k]]), ("name", name[k]), ("start", cut[phrase[k]]), ("size", size[k])):
                    out[key].append(x)
            return {k: np.concatenate(v) for k, v in out.items()}

        return step

    joined = blocks.select("block", "tids", "cuts", "names", "anchors").join(repeated, "block")
    return in_arrow(joined, begin, "block long, tid long, i int, name long, start int, size int", weigh=None)


def _runs(repeated: DataFrame) -> DataFrame:
    """Blocks of strings, with tids of the strings, starts and sizes of the phrases: stretches of consecutive phrases of (block, tid, i, name, start, size)."""

    def whole(x: dict) -> dict:
        heads, first = _firsts(x["tid"], x["i"] - np.arange(len(x["i"]))), _firsts(x["block"])
        out = _strings(x["block"], heads, x["name"])
        tids = pa.ListArray.from_arrays(out["firsts"].offsets, pa.array(x["tid"][heads]))
        return out | {"tids": tids, "starts": _as_lists(first, x["start"]), "sizes": _as_lists(first, x["size"])}

    rows = repeated.select("block", "tid", "i", "name", "start", "size").repartition("block").sortWithinPartitions("block", "tid", "i")
    return _grouped(rows, f"block long, {STRINGS}, tids array<long>, starts array<int>, sizes array<int>", whole)


def _heads(joined: DataFrame) -> DataFrame:
    """(block, place, rank) of each phrase."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            x = _Flat(batch)
            return {"block": x.block, "place": x.place, "rank": _lists(batch.column("ranks"))[1]}

        return step

    return in_arrow(joined.select("block", "firsts", "values", "ranks"), begin, "block long, place int, rank long", weigh=None)


def _prefixes(strings: DataFrame, wanted: DataFrame, enough: int) -> DataFrame:
    """(block, place, rank, n, values, sizes): for the places ``wanted`` of each block, the phrases from there on until they have ``enough`` bytes."""

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            x = _Flat(batch)
            sizes = _lists(batch.column("sizes"))[1]
            asked, _ = _lists(batch.column("asked"))
            flat = batch.column("asked").flatten()
            first = np.repeat(x.bounds[:-1], np.diff(asked)) + flat.field("place").to_numpy()
            ends = np.cumsum(sizes)
            last = np.minimum(np.searchsorted(ends, ends[first] - sizes[first] + enough) + 1, x.end[first])
            n = last - first
            at, to = ragged(first, n), pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            return {"block": x.block[first], "place": flat.field("place"), "rank": flat.field("rank"), "n": flat.field("n"), "values": pa.ListArray.from_arrays(to, pa.array(x.values[at])), "sizes": pa.ListArray.from_arrays(to, pa.array(sizes[at]))}

        return step

    asked = wanted.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "n")).alias("asked"))
    joined = strings.select("block", "firsts", "values", "sizes").join(asked, "block")
    return in_arrow(joined, begin, "block long, place int, rank long, n long, values array<long>, sizes array<int>", weigh=None)


def _compare(table: pa.Table) -> pa.Table:
    """(block, place, shared) of the suffixes equal to no other: bytes that they share with the ones beside them in the array."""
    table = table.combine_chunks().sort_by("rank")
    rank, n = table.column("rank").to_numpy(), table.column("n").to_numpy()
    bounds, values = _lists(table.column("values").combine_chunks())
    _, sizes = _lists(table.column("sizes").combine_chunks())
    length = np.diff(bounds)
    pair = np.flatnonzero(rank[:-1] + n[:-1] == rank[1:])
    shared, k, on = np.zeros(len(pair), np.int64), 0, np.arange(len(pair))
    while len(on):
        a, b = pair[on], pair[on] + 1
        on = on[(k < length[a]) & (k < length[b])]
        a, b = bounds[pair[on]] + k, bounds[pair[on] + 1] + k
        same = values[a] == values[b]
        on = on[same]
        shared[on] += sizes[a[same]]
        k += 1
    most = np.zeros(len(rank), np.int64)
    np.maximum.at(most, pair, shared)
    np.maximum.at(most, pair + 1, shared)
    alone = pa.array(n == 1)
    return pa.table({"block": table.column("block").filter(alone), "place": table.column("place").filter(alone), "shared": pa.array(most[n == 1], pa.int32())})


def _reach(strings: DataFrame, ranks: DataFrame, enough: int) -> DataFrame:
    """(tid, starts, reach): of each text the phrases' starts and the bytes of whole phrases from there that occur elsewhere too; ``enough`` at most. A stored table."""
    # one phrase stands for all with its rank: their suffixes are equal
    classes = stored(_heads(strings.join(ranks, "block")).groupBy("rank").agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("block", "place")]))
    at = lambda c: F.floor(c / ADJACENT)
    # a class goes where it stands, and where its successor stands
    dealt = _prefixes(strings, classes, enough).select("*", F.explode(F.array_distinct(F.array(at(F.col("rank")), at(F.col("rank") + F.col("n"))))).alias("bucket"))
    alone = dealt.groupBy("bucket").applyInArrow(_compare, "block long, place int, shared int")
    alone = alone.groupBy("block").agg(F.collect_list(F.struct("place", "shared")).alias("alone"))

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            x = _Flat(batch)
            ends = np.concatenate(([0], np.cumsum(_lists(batch.column("sizes"))[1])))
            reach = np.minimum(ends[x.end] - ends[:-1], enough)  # a suffix with an equal one repeats to its string's end
            told = batch.column("alone")
            first = np.repeat(x.bounds[:-1], pc.fill_null(pc.list_value_length(told), 0).to_numpy())
            at = first + told.flatten().field("place").to_numpy()
            shared = np.zeros(len(reach), np.int64)
            np.maximum.at(shared, at, told.flatten().field("shared").to_numpy())
            reach[at] = np.minimum(reach[at], shared[at])
            on = np.flatnonzero(reach > 0)
            tid = _lists(batch.column("tids"))[1][x.string[on]]
            head = _firsts(tid) if len(on) else on
            return {"tid": tid[head], "starts": _as_lists(head, _lists(batch.column("starts"))[1][on]), "reach": _as_lists(head, reach[on].astype(np.int32))}

        return step

    out = stored(in_arrow(strings.join(alone, "block", "left"), begin, "tid long, starts array<int>, reach array<int>", weigh=None))
    drop_stored(classes)
    return out


def _leasts(data: np.ndarray, window: int) -> np.ndarray:
    """For each window of places the one with the least hash, the leftmost of equal ones."""
    n = len(data)
    bits = max(int(n).bit_length(), 1)
    low = np.uint64((1 << bits) - 1)
    least = _grams(data) & ~low | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    return (least & low).astype(np.int64)


def _solid(raw: bytes, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where equal phrases follow each other: starts and ends of such pairs; and starts and lengths of what so occurs again, a phrase further on."""
    size = np.diff(cut)
    even = np.flatnonzero(size[:-1] == size[1:])
    same = [raw[a:b] == raw[b:c] for a, b, c in zip(cut[even].tolist(), cut[even + 1].tolist(), cut[even + 2].tolist(), strict=True)]
    pair = even[np.array(same, bool)]
    if not len(pair):
        return pair, pair, pair, pair
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1] + 1)))
    last = np.append(first[1:], len(pair)) - 1
    start, stop, q = cut[pair[first]], cut[pair[last] + 2], size[pair[first]]
    return cut[pair], cut[pair + 2], np.concatenate((start, start + q)), np.tile(stop - start - q, 2)


def _places(data: np.ndarray, starts: np.ndarray, reach: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and reaches with those that equal phrases in a row add; places from which ``length`` bytes may repeat, the first cut of each, and whether it is settled that they do.

    Where they repeat, the least place of their first window and that of their last are cuts of
    either occurrence, and the phrases between these repeat, or hold equal ones in a row.
    """
    n = len(data)
    least = _leasts(data, window)
    valid = least[: max(n - window - _GRAM + 2, 0)]
    chosen = np.zeros(n, bool)
    chosen[valid] = True
    pair, pair_end, more, far = _solid(data.tobytes(), np.flatnonzero(chosen))
    known = np.zeros(n + 1, np.int64)
    known[starts] = reach
    first = least[: n - length + 1]
    last = least[length - _GRAM - window + 1 :][: n - length + 1]
    starts, reach = np.concatenate((starts, more)), np.concatenate((reach, far))
    sure = np.zeros(n + 1, np.int64)
    ok = reach >= length
    np.add.at(sure, starts[ok], 1)
    np.add.at(sure, starts[ok] + reach[ok] - length + 1, -1)
    maybe = (known[first] >= last - first) & (known[first] > 0)
    if len(pair):
        k = np.searchsorted(pair, first)
        maybe |= (k < len(pair)) & (pair_end[np.minimum(k, len(pair) - 1)] <= last)
    at = np.flatnonzero(maybe)
    return starts, reach, at, first[at], np.cumsum(sure)[at] > 0


def _anchors(raw: bytes, at: np.ndarray, ahead: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(raw[a : a + ahead], 1) for a in at.tolist()], np.uint64).view(np.int64)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base, at least, and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, x, np.uint64))))
    return _POWERS


def _window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place: of sums of mixed bytes in eights, weighted by powers."""
    power, back = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_grams(data) * power[: len(data)])))
    return _mixed((sums[at + length - _GRAM + 1] - sums[at]) * back[at])


def _removed(n: int, starts: np.ndarray, reach: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Edges of maximal runs of bytes in a repeated passage: start, stop, start, ..."""
    ok = reach >= length
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts[ok], 1)
    np.add.at(change, starts[ok] + reach[ok], -1)
    np.add.at(change, places, 1)
    np.add.at(change, places + length, -1)
    inside = np.cumsum(change)[:-1] > 0
    return np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))


def repeats(docs: DataFrame, length: int = 400, small: int = SMALL, read: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Per row (doc_id, text_hash, n_bytes, sha256), and per text with something to remove (text_hash, copies, n_removed, n_spans, kept_sha256, edges); empty input gives empty tables."""
    window = _window(length)
    held = stored(phrases(docs, length, read))
    texts = held.where(F.col("n_bytes") >= length).groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.any_value(F.struct("n_bytes", "cuts", "names", "anchors")).alias("x"))
    known = stored(_text_blocks(texts.select("text_hash", "rep", "copies", "x.*")))
    zipped = F.explode(F.arrays_zip("tids", "text_hashes", "reps", "copies", "n_bytes")).alias("x")
    texts = known.select(zipped).select(F.col("x.tids").alias("tid"), F.col("x.text_hashes").alias("text_hash"), F.col("x.reps").alias("rep"), "x.copies", "x.n_bytes")
    n_cuts = known.select(F.sum(F.aggregate("anchors", F.lit(0).cast("long"), lambda n, x: n + F.size(x)))).first()[0] or 0
    repeated = _repeated_anchors(known, n_cuts)
    behind = stored(_phrases_behind(known, repeated, length))
    again = behind.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    strings = stored(_runs(join_spread(behind, again, ["name"], "n", n_cuts, "start")))
    drop_stored(behind, repeated)
    ranks = suffix_ranks(strings, small)
    reach = _reach(strings, ranks, length + window)
    drop_stored(strings, ranks)
    wanted = texts.join(reach, "tid").select("text_hash", "rep", "copies", "n_bytes", "starts", "reach")
    size = wanted.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    texts_of = stored(_blocks(_with_texts(docs, wanted), read))
    drop_stored(reach)
    blocks = stored(_with_masks(texts_of, length, window))
    drop_stored(texts_of)
    answers = _answers(_dealt(blocks, buckets, length, window))
    grouped = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "again"))).alias("answers"))
    cut = in_arrow(blocks.join(grouped, "block", "left"), lambda: _cut_step(length, window), "text_hash binary, copies long, n_removed long, n_spans int, kept_sha256 string, edges array<int>", weigh=None)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = texts.where("copies > 1").select("text_hash", "copies", F.col("n_bytes").alias("n_removed"), F.lit(1).alias("n_spans"), nothing.alias("kept_sha256"), F.array(F.lit(0), F.col("n_bytes").cast("int")).alias("edges"))
    removed = stored(cut.union(whole))
    drop_stored(known, blocks, answers)
    return held.select("doc_id", "text_hash", "n_bytes", "sha256"), removed


def _hashed(docs: DataFrame, read: Callable | None = None) -> DataFrame:
    """``docs``, all columns, and _hash, the hash of the text's bytes, or of those of what is read for it; null counts as empty."""
    names = docs.columns

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            return {k: batch.column(k) for k in names} | {"_hash": [xxhash.xxh3_128_digest((x or "").encode()) for x in (read(texts) if read else texts)]}

        return step

    from pyspark.sql.types import BinaryType, StructType

    return in_arrow(docs, begin, StructType([*docs.schema, StructType().add("_hash", BinaryType())[0]]))


def _with_edges(docs: DataFrame, rows: DataFrame, removed: DataFrame, read: Callable | None = None) -> DataFrame:
    """``docs``, all columns, and _edges, those of what is removed from the text; null if nothing is."""
    edges = removed.select(F.col("text_hash").alias("_hash"), F.col("copies").alias("_copies"), F.col("edges").alias("_edges"))
    return join_spread(_hashed(docs, read), edges, ["_hash"], "_copies", rows.count(), "doc_id", "left").drop("_hash", "_copies")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with texts of its doc_ids: that of the text_hash, and others if a doc_id has more than one."""
    return docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep")


def _blocks(rows: DataFrame, read: Callable | None = None) -> DataFrame:
    """(block, texts): a row for some MB of texts, with what is known of each; texts with another hash than asked for are left out.

    One of a text's copies stands for all, or more where copies have one doc_id: all their
    passages occur again anyhow.
    """
    kind = "array<struct<text_hash:binary,copies:long,text:string,starts:array<int>,reach:array<int>>>"

    def begin():
        task, made = TaskContext.get().partitionId(), 0

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal made
            made += 1
            texts = batch.to_pylist()
            if read:
                texts = [t | {"text": x} for t, x in zip(texts, read([t["text"] for t in texts]), strict=True)]
            texts = [t for t in texts if xxhash.xxh3_128_digest((t["text"] or "").encode()) == t["text_hash"]]
            return {"block": [task << 32 | made], "texts": [texts]}

        return step

    return in_arrow(rows.select("text_hash", "copies", "text", "starts", "reach"), begin, f"block long, texts {kind}").where("size(texts) > 0")


def _anchored(t: dict, length: int, window: int):
    """A text's bytes, starts and reaches; its places, the anchor of each, how far before its cut it is, and whether it is settled."""
    data = np.frombuffer(t["text"].encode(), np.uint8)
    starts, reach = np.array(t["starts"], np.int64), np.array(t["reach"], np.int64)
    starts, reach, at, first, sure = _places(data, starts, reach, length, window)
    cut, back = np.unique(first, return_inverse=True)
    return data, starts, reach, at, _anchors(data.tobytes(), cut, length - window + 1)[back], first - at, sure


def _with_masks(blocks: DataFrame, length: int, window: int) -> DataFrame:
    """``blocks`` with masks: for the anchors that each has, the distances, a bit each, at which some text has an unsettled place."""
    n = -(-window // 64)
    columns = [f"m{k}" for k in range(n)]

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            out = {k: [np.zeros(0, np.int64)] for k in ("block", "anchor", *columns)}
            for row in batch.to_pylist():
                found = [_anchored(t, length, window)[4:] for t in row["texts"]]
                anchor, distance, sure = (np.concatenate(x) for x in zip(*found, strict=True))
                names, back = np.unique(anchor, return_inverse=True)
                mask = np.zeros((len(names), n), np.uint64)
                open_ = np.flatnonzero(~sure)
                np.bitwise_or.at(mask, (back[open_], distance[open_] // 64), np.uint64(1) << (distance[open_] % 64).astype(np.uint64))
                out["block"].append(np.full(len(names), row["block"]))
                out["anchor"].append(names)
                for k, c in enumerate(columns):
                    out[c].append(mask[:, k].copy().view(np.int64))
            return {k: np.concatenate(v) for k, v in out.items()}

        return step

    there = stored(in_arrow(blocks, begin, "block long, anchor long, " + ", ".join(f"{c} long" for c in columns), weigh=None))
    masks = there.groupBy("anchor").agg(*[F.bit_or(c).alias(c) for c in columns])
    masks = masks.where(" or ".join(f"{c} <> 0" for c in columns))
    grouped = there.select("block", "anchor").join(masks, "anchor").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("anchor", F.array(*columns).alias("mask")))).alias("masks"))
    return blocks.join(grouped, "block", "left")


def _places_of(row: dict, length: int, window: int):
    """For each text of a block: its bytes, starts and reaches, and the places, with their hashes, that are unsettled in some text with the same anchor."""
    anchors = np.array([x["anchor"] for x in row["masks"] or []], np.int64)
    masks = np.array([x["mask"] for x in row["masks"] or []], np.int64).view(np.uint64)
    for t in row["texts"]:
        data, starts, reach, at, anchor, distance, _ = _anchored(t, length, window)
        if len(anchors) and len(at):
            k = np.minimum(np.searchsorted(anchors, anchor), len(anchors) - 1)
            asked = masks[k, distance // 64] >> (distance % 64).astype(np.uint64) & np.uint64(1)
            at = at[(anchors[k] == anchor) & (asked > 0)]
        else:
            at = at[:0]
        yield t, data, starts, reach, at, _window_hashes(data, at, length)


def _dealt(blocks: DataFrame, buckets: int, length: int, window: int) -> DataFrame:
    """(bucket, block, hashes, counts): the distinct hashes of a block's open places in a hash range, and how often it has them."""
    limits = runs.edges(buckets)

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            out = {"bucket": [], "block": [], "hashes": [], "counts": []}
            for row in batch.to_pylist():
                places = [(x[0]["copies"], x[-1]) for x in _places_of(row, length, window)]
                found, counts = np.unique(np.concatenate([x for copies, x in places for _ in range(min(copies, 2))]), return_counts=True)
                for bucket, a, b in runs.ranges(found, limits):
                    for k, x in (("bucket", bucket), ("block", row["block"]), ("hashes", runs.packed_run(found[a:b])), ("counts", runs.packed(counts[a:b], 4))):
                        out[k].append(x)
            return out

        return step

    return in_arrow(blocks, begin, "bucket int, block long, hashes binary, counts binary", weigh=None)


def _answers(dealt: DataFrame) -> DataFrame:
    """(block, bucket, again): for the hashes of ``dealt``, in their order, a byte that says whether they occur again."""

    def join(table: pa.Table) -> pa.Table:
        totals = runs.summed([runs.unpacked_run(x) for x in table.column("hashes").to_pylist()], [runs.unpacked(x, 4) for x in table.column("counts").to_pylist()])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "again": pa.array([runs.packed(x > 1, 1) for x in totals], pa.binary())})

    return stored(dealt.groupBy("bucket").applyInArrow(join, "block long, bucket int, again binary"))


def _cut_step(length: int, window: int) -> Callable:
    def step(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("text_hash", "copies", "n_removed", "n_spans", "kept_sha256", "edges")}
        for row in batch.to_pylist():
            texts = list(_places_of(row, length, window))
            found = np.unique(np.concatenate([x[-1] for x in texts]))
            again = np.concatenate([np.zeros(0, np.uint64), *[runs.unpacked(x["again"], 1) for x in row["answers"] or []]]) > 0
            for t, data, starts, reach, at, hashes in texts:
                if t["copies"] > 1:
                    continue
                edges = _removed(len(data), starts, reach, at[again[np.searchsorted(found, hashes)]], length)
                if len(edges):
                    kept = hashlib.sha256(_kept(data.tobytes(), edges.tolist())).hexdigest()
                    for k, x in (("text_hash", t["text_hash"]), ("copies", 1), ("n_removed", int((edges[1::2] - edges[::2]).sum())), ("n_spans", len(edges) // 2), ("kept_sha256", kept), ("edges", edges)):
                        out[k].append(x)
        return out

    return step


def _kept(data: bytes, edges: list[int]) -> bytes:
    ends = [0, *edges, len(data)]
    return b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def report(docs: DataFrame, length: int = 400, small: int = SMALL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    A text's UTF-8 bytes are removed where ``length`` of them also start anywhere else, in this
    text or another row's; the first occurrence too. A null text counts as empty. Repeated rows
    are occurrences of each other. Shorter texts lose nothing. An empty table gives an empty
    one. Columns but doc_id and text are left out.
    """
    rows, removed = repeats(docs, length, small)
    out = join_spread(rows, removed.drop("edges"), ["text_hash"], "copies", rows.count(), "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 400, small: int = SMALL) -> DataFrame:
    """``docs``, all columns, with the repeated passages cut out of text; what a cut leaves of a character goes too. Rows of which nothing is left but white space are dropped if something was cut."""
    out, names = _with_edges(docs, *repeats(docs, length, small)), docs.columns

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [t if e is None else _kept(t.encode(), e).decode("utf-8", "ignore") for t, e in zip(batch.column("text").to_pylist(), batch.column("_edges").to_pylist(), strict=True)]
            stay = pa.array([e is None or bool(t.strip()) for t, e in zip(texts, batch.column("_edges").to_pylist(), strict=True)])
            return {k: (pa.array(texts, pa.string()) if k == "text" else batch.column(k)).filter(stay) for k in names}

        return step

    return in_arrow(out, begin, docs.schema)


class _Codes(dict):
    def __missing__(self, word: str) -> str:
        if len(self) >= _REMEMBERED:
            self.clear()
        # eight bytes are 11 characters; the first _CODE are 36 bits of them
        code = self[word] = base64.b64encode(xxhash.xxh3_64_digest(word.encode()))[:_CODE].decode()
        return code


def _coded(texts: list[str | None]) -> list[str]:
    """Each text's words, what white space divides, as _CODE characters each and nothing between them."""
    codes = worker_held("word codes", _Codes)
    return ["".join([codes[w] for w in (x or "").split()]) for x in texts]


def _without_words(text: str, edges: list[int], words: int) -> str:
    """``text`` without the runs of ``words`` words or more between ``edges`` of its code; white space around them stays."""
    at = [m.span() for m in re.finditer(r"\S+", text)]
    out, done = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        first, end = -(-a // _CODE), b // _CODE  # characters beside a run may be equal by chance
        if end - first >= words:
            out.append(text[done : at[first][0]])
            done = at[end - 1][1]
    return "".join(out) + text[done:]


def without_repeated_words(docs: DataFrame, words: int = 51, small: int = SMALL) -> DataFrame:
    """``docs``, all columns, with the passages of ``words`` words or more that also occur elsewhere, in this text or another row's, cut out; the first occurrence too.

    Words are what white space divides, whatever white space it is. The passages are those of
    texts with a code of equal length for each word, of 36 bits, so any length in bytes counts.
    Rows of which nothing is left but white space are dropped if something was cut.
    """

    out, names = _with_edges(docs, *repeats(docs, words * _CODE, small, _coded), _coded), docs.columns

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            edges = batch.column("_edges").to_pylist()
            before = batch.column("text").to_pylist()
            texts = [t if e is None else _without_words(t, e, words) for t, e in zip(before, edges, strict=True)]
            stay = pa.array([t == x or bool(t.strip()) for t, x in zip(texts, before, strict=True)])
            return {k: (pa.array(texts, pa.string()) if k == "text" else batch.column(k)).filter(stay) for k in names}

        return step

    return in_arrow(out, begin, docs.schema)
