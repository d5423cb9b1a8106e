"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the pairs of neighbours are
looked up by binary search among the sorted pair keys, and in every word all places of its
lowest-ranked pair are merged, from the left. Words without a pair left leave the array.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_arrow, ragged, worker_held
from .tokens import StretchEncoder, byte_letters

#: The pre-tokenizer's pattern of byte-level vocabularies (fixed by them).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more symbols than this are merged one by one with a heap, as rounds over them would take quadratic time.
LONG_WORD = 1024
_NONE = np.iinfo(np.int64).max


class Bpe:
    """A byte-level vocabulary in the tokenizers library's file format: ``encode(texts)`` and ``decode(ids, bounds)``.

    Without special tokens added, truncation or padding; a special token's string in a text
    becomes its id, as in the library. Null and empty texts have no ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = {c: b for b, c in letters.items()}
        strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(strings) + 1
        self.token_length = np.array([len(strings.get(i, b"")) for i in range(size)], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(strings.get(i, b"") for i in range(size)), np.uint8)
        self._words = regex.compile(PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._encoder = StretchEncoder(self._encode_each, list(self.special))

    def encode(self, texts: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin."""
        return self._encoder.encode(texts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each row of ids; special tokens are kept."""
        lengths = self.token_length[ids]
        data = self.token_bytes[ragged(self.token_start[ids], lengths)].tobytes()
        at = np.concatenate(([0], np.cumsum(lengths)))[bounds]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]

    def _encode_each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = [], []
        for s in strings:
            if self._special and self._special.search(s):
                found = [w for part in self._special.split(s) for w in ([part] if part in self.special else self._words.findall(part))]
            else:
                found = self._words.findall(s)
            words += found
            counts.append(len(found))
        lengths, ids = self.encode_words(words)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))]
        return np.diff(ends), ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each pre-token, and all ids."""
        data = [b"" if w in self.special else w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        symbols = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
        bounds = np.concatenate(([0], np.cumsum(size)))
        out = symbols.copy()
        left = np.ones(len(symbols), bool)  # symbols that stay
        short = np.flatnonzero((size > 1) & (size <= LONG_WORD))
        self._rounds(out, left, bounds, short)
        for k in np.flatnonzero(size > LONG_WORD):
            merged = self._heap_merge(symbols[bounds[k] : bounds[k + 1]].tolist())
            out[bounds[k] : bounds[k] + len(merged)] = merged
            left[bounds[k] + len(merged) : bounds[k + 1]] = False
        kept = np.concatenate(([0], np.cumsum(left)))[bounds]
        lengths, ids = np.diff(kept), out[left].astype(np.int32)
        if self._special and any(not d and w for d, w in zip(data, words, strict=True)):
            which = [k for k, w in enumerate(words) if w in self.special]
            ids = np.insert(ids, kept[which], [self.special[words[k]] for k in which])
            lengths[which] = 1
        return lengths, ids

    def _rounds(self, out: np.ndarray, left: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> None:
        size = np.diff(bounds)[words]
        place = ragged(bounds[words], size)  # where each symbol lies in out
        symbol = out[place]
        word = np.repeat(np.arange(len(words)), size)
        while len(symbol) > 1:
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], _NONE)
            rank = np.append(rank, _NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            hit = (rank == np.repeat(lowest, sizes)) & (rank != _NONE)
            # of overlapping places (one symbol repeated) every second one counts, from the left
            k = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), k, 0))
            hit &= (k - run) % 2 == 0
            hits = np.flatnonzero(hit)
            symbol[hits] = self.made[at[hits]]
            out[place[hits]] = symbol[hits]
            left[place[hits + 1]] = False
            stay = np.repeat(lowest != _NONE, sizes)
            stay[hits + 1] = False
            symbol, word, place = symbol[stay], word[stay], place[stay]

    def _heap_merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> tuple[int, int] | None:
            if after[i] >= n:
                return None
            key = symbols[i] << 32 | symbols[after[i]]
            at = int(np.searchsorted(self.keys, key))
            return (int(self.rank[at]), at) if at < len(self.keys) and self.keys[at] == key else None

        heap = [(found[0], i, found[1]) for i in range(n) if (found := pair(i))]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rank, i, at = heapq.heappop(heap)
            if gone[i] or (now := pair(i)) is None or now[0] != rank:
                continue
            j = after[i]
            symbols[i], gone[j], after[i] = int(self.made[at]), True, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0 and (found := pair(k)):
                    heapq.heappush(heap, (found[0], k, found[1]))
        return [s for s, out in zip(symbols, gone, strict=True) if not out]


def worker_bpe(path: str) -> Bpe:
    return worker_held(("numpy", path), lambda: Bpe(path))


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each document.

    Null text counts as empty: no ids, an empty decoded text. Repeated rows give repeated
    rows, a null doc_id stays null, an empty table gives an empty one; other columns are left out.
    """

    def begin():
        bpe = worker_bpe(tokenizer_path)

        def step(batch: pa.RecordBatch) -> dict:
            ids, bounds = bpe.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            return {"doc_id": batch.column("doc_id"), "ids": lists, "decoded": bpe.decode(ids, bounds)}

        return step

    return in_arrow(docs.select("doc_id", "text"), begin, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encode_decode`` reduced to (doc_id, n_tokens, ids_sha256, decoded_sha256) in the same step, so that neither ids nor texts travel back to Spark."""

    def begin():
        bpe = worker_bpe(tokenizer_path)

        def step(batch: pa.RecordBatch) -> dict:
            ids, bounds = bpe.encode(batch.column("text"))
            data = memoryview(ids.astype("<u4")).cast("B")
            of = lambda b: hashlib.sha256(b).hexdigest()
            return {"doc_id": batch.column("doc_id"), "n_tokens": np.diff(bounds), "ids_sha256": [of(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], "decoded_sha256": [of(x.encode()) for x in bpe.decode(ids, bounds)]}

        return step

    return in_arrow(docs.select("doc_id", "text"), begin, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
