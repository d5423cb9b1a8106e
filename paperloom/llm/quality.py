"""Quality rules with suffix-array repetition.

The symbols are a document's words. Suffixes of many documents are sorted at once by prefix
doubling; the ranks of each round are kept, so that the longest common prefix of suffixes that
are next to each other is found by halving steps. The intervals of these prefixes give at each
word the longest substring that begins there and occurs again; their spans are united, and the
covered fraction and the longest repeat are limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, covered double, spans array<struct<start:int,stop:int>>, base_failed boolean, kept boolean"


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def suffix_ranks(symbol: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, each document by itself, until they differ.

    A suffix that ends sooner is less. A suffix that is already alone keeps its rank.
    """
    n = len(symbol)
    end = np.searchsorted(doc, doc, side="right")  # where each one's document ends
    order = np.lexsort((symbol, doc))
    rank = _named(order, (doc[order], symbol[order]), n)
    ranks, span = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return ranks
        after = open_ + span
        inside = after < end[open_]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        group = rank[open_][order]
        group_first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        begin = np.repeat(group_first, np.diff(np.append(group_first, len(group))))
        nxt = rank.copy()
        nxt[open_[order]] = group + first - begin  # the group's rank, which is its first place, and the place within
        span *= 2
        if (nxt == rank).all() and not inside.any():
            return ranks
        rank = nxt
        ranks.append(rank)


def _named(order: np.ndarray, keys: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return rank


def repeat_lengths(symbol: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """At each symbol the length of the longest substring from there that also starts elsewhere in its document."""
    n = len(symbol)
    if n == 0:
        return np.zeros(0, np.int64)
    ranks = suffix_ranks(symbol, doc)
    sa = np.argsort(ranks[-1], kind="stable")
    a, b = sa[:-1].copy(), sa[1:].copy()
    same = np.flatnonzero(ranks[0][a] == ranks[0][b])  # the others' common prefix is empty
    a, b = a[same], b[same]
    at, bt, lcp = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    last = np.searchsorted(doc, doc, side="right")
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if k == len(ranks) - 1 else 1):
            ok = (at < last[a]) & (bt < last[b])
            i, j = np.where(ok, at, 0), np.where(ok, bt, 0)
            ok &= (ranks[k][i] == ranks[k][j]) & (np.maximum(at, bt) + (1 << k) <= np.where(at > bt, last[a], last[b]))
            step = ok.astype(np.int64) << k
            at, bt, lcp = at + step, bt + step, lcp + step
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change)[:-1] > 0


def measure(texts: list[str | None], least_repeat: int, most_covered: float, most_repeat: int) -> dict:
    """The rules' figures and verdicts, a list each, for texts handled together."""
    numbers, ids, counts, sizes = _Numbers(), [], [], []
    word_chars, symbols, dup_lines = [], [], []
    for text in texts:
        text = text or ""
        words = text.encode().split()
        ids += [numbers[w] for w in words]
        counts.append(len(words))
        sizes += map(len, words)
        word_chars.append(len(text) - sum(map(text.count, SPACES)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else ()
        dup_lines.append(len(lines) - len(set(lines)))
    n_words = np.array(counts, np.int64)
    symbol, size = np.array(ids, np.int64), np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    ends = np.cumsum(n_words)
    lengths = repeat_lengths(symbol, doc)
    windows = np.flatnonzero(lengths >= 3)
    total = lambda x: np.bincount(doc, x, len(texts)).astype(np.int64)
    repeat_words = total(_covered(windows, np.full(len(windows), 3), len(symbol)))
    long_ = np.flatnonzero(lengths >= least_repeat)
    inside = _covered(long_, lengths[long_], len(symbol))
    covered = total(size * inside) / np.maximum(total(size), 1)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, lengths)
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    # a span doesn't run on into the next document
    cut = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(symbol))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(symbol) else cut[:0]
    starts = np.sort(np.concatenate((np.flatnonzero(edge == 1), cut)))
    stops = np.sort(np.concatenate((np.flatnonzero(edge == -1), cut)))
    base = (ends - n_words)[doc[starts]] if len(starts) else starts
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[starts], minlength=len(texts)) if len(starts) else np.zeros(len(texts))))).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(starts - base, pa.int32()), pa.array(stops - base, pa.int32())], names=["start", "stop"]),
    )
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    kept = ~failed & (covered <= most_covered) & (longest <= most_repeat)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "longest_repeat": longest, "covered": covered, "spans": spans, "base_failed": failed, "kept": kept}


def judged(docs: DataFrame, least_repeat: int = 10, most_covered: float = 0.3, most_repeat: int = 150) -> DataFrame:
    """doc_id with SCHEMA for each row.

    least_repeat: words of the repeats that count as covering. covered: the fraction of the
    words' bytes in them. spans: their union, in words. longest_repeat: in words.
    A null text has no words and so fails, as an empty one. Repeated rows get equal verdicts.
    An empty table gives an empty one. Columns but doc_id and text are left out.
    """

    def begin():
        return lambda batch: {"doc_id": batch.column("doc_id"), **measure(batch.column("text").to_pylist(), least_repeat, most_covered, most_repeat)}

    return in_arrow(docs.select("doc_id", "text"), begin, f"doc_id long, {SCHEMA}")


def keep_good(docs: DataFrame, least_repeat: int = 10, most_covered: float = 0.3, most_repeat: int = 150) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep: verdicts are made beside the rows, without a join."""
    schema = docs.schema
    names = docs.columns

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            good = pa.array(measure(batch.column("text").to_pylist(), least_repeat, most_covered, most_repeat)["kept"])
            return {k: batch.column(k).filter(good) for k in names}

        return step

    return in_arrow(docs, begin, schema)
