"""Language identification with bit-sliced Bloom filters of n-grams.

Each language has the set of its training texts' letter n-grams in a Bloom filter. The
filters are sliced: a slot holds one bit for each language, so that one lookup tells all
languages that may have an n-gram. A text's n-grams are counted by language from these
masks, the counts are corrected for the filters' false positives, and the largest wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

UNDETERMINED = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[65]:
        for start, stop in ((0, 0x33480), (0xE0000, 0xE0200)):
            _LETTER[start:stop] = [chr(c).isalpha() for c in range(start, stop)]
    return _LETTER


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' n-grams, the row of each, and which rows have a letter.

    n-grams are of the lower-cased letters with each stretch of others as one space, a space
    at either end, and don't run across a space: a word of one letter has those of `` x ``.
    """
    joined = "\n".join((x or "").lower().replace("\n", " ") for x in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    row = np.cumsum(codes == 10) - (codes == 10)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a space, or the row's end, after a letter
    chars = np.where(letter, codes, 32)[keep].astype(np.uint64)
    row, letter = row[keep], letter[keep]
    chars, row, letter = np.concatenate(([np.uint64(32)], chars)), np.concatenate((row[:1], row)), np.concatenate(([False], letter))
    has = np.zeros(len(texts), bool)
    has[row[letter]] = True
    size = len(chars) - n + 1
    if size < 1 or not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    value = np.zeros(size, np.uint64)
    whole = np.ones(size, bool)
    for k in range(n):
        value = (value ^ chars[k : k + size]) * _MIX
        value ^= value >> np.uint64(29)
        if 0 < k < n - 1:
            whole &= letter[k : k + size]
    return _mixed(value[whole]), row[n - 1 :][whole], has


@dataclass
class BitSliced:
    """slots: an unsigned integer per slot, or a row of them; languages: by bit."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_rate: np.ndarray
    n: int

    @classmethod
    def build(cls, sets: dict[str, np.ndarray], n: int, hashes: int = 4, slots_each: int = 12) -> BitSliced:
        languages = sorted(sets)
        most = max((len(x) for x in sets.values()), default=1)
        size = 1 << max(10, int(most * slots_each - 1).bit_length())
        bits = next((b for b in (8, 16, 32, 64) if b >= len(languages)), 64)
        kind = np.dtype(f"u{bits // 8}")
        slots = np.zeros((size, -(-len(languages) // bits)), kind)
        fill = np.zeros(len(languages))
        for k, name in enumerate(languages):
            at = np.concatenate([_slot(sets[name], i, size) for i in range(hashes)])
            np.bitwise_or.at(slots[:, k // bits], at, kind.type(1 << (k % bits)))
            fill[k] = len(np.unique(at)) / size
        return cls(languages, slots, hashes, fill**hashes, n)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that may contain it, a bit each."""
        out = self.slots[_slot(grams, 0, len(self.slots))]
        for k in range(1, self.hashes):
            out &= self.slots[_slot(grams, k, len(self.slots))]
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected counts by row and language, the number of n-grams by row, and which rows have a letter."""
        grams, row, has = ngrams(texts, self.n)
        masks, bits = self.masks(grams), self.slots.dtype.itemsize * 8
        total = np.bincount(row, minlength=len(texts))
        seen = np.stack([np.bincount(row[(masks[:, k // bits] >> (k % bits)) & 1 != 0], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        return np.maximum(seen - total[:, None] * self.false_rate, 0) / (1 - self.false_rate), total, has


def _slot(grams: np.ndarray, k: int, size: int) -> np.ndarray:
    return ((grams + np.uint64(k) * ((grams >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1)).astype(np.int64)


def train(labelled: DataFrame, n: int = 4, rows_each: int = 2000, grams_each: int = 100_000, at_least: int = 3) -> BitSliced | None:
    """Filters of the languages in ``labelled`` (text, lang); None if it has no row with both.

    Of each language about ``rows_each`` distinct texts are taken, by a hash of the text, and of
    their n-grams those found ``at_least`` times, the ``grams_each`` most frequent ones at most:
    these bounds keep what comes to the driver small at any size of the table. Where no n-gram
    of a language is found so often, those found most often are taken.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    hashes = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    sizes = {x["lang"]: x["n"] for x in hashes.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(y) for lang, m in sizes.items() for y in (lang, min(1.0, rows_each / m))])[F.col("lang")]
    taken = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "text"])

    def begin():
        def step(batch: pa.RecordBatch) -> dict:
            names = batch.column("lang").to_pylist()
            grams, row, _ = ngrams(batch.column("text").to_pylist(), n)
            langs, code = np.unique(np.array(names, object), return_inverse=True)
            out = {"lang": [], "gram": [], "n": []}
            for k, lang in enumerate(langs):
                gram, times = np.unique(grams[code[row] == k], return_counts=True)
                out["lang"] += [lang] * len(gram)
                out["gram"].append(gram.view(np.int64))
                out["n"].append(times)
            return out | {k: np.concatenate(out[k]) for k in ("gram", "n")}

        return step

    counted = in_arrow(taken, begin, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    most = counted.groupBy("lang").agg(F.least(F.max("n"), F.lit(at_least)).alias("enough"))
    counted = counted.join(F.broadcast(most), "lang").where("n >= enough")  # a row a language
    best = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= grams_each).select("lang", "gram").toPandas()
    sets = {lang: np.zeros(0, np.uint64) for lang in sizes} | {lang: part["gram"].to_numpy().view(np.uint64) for lang, part in best.groupby("lang")}
    return BitSliced.build(sets, n)


def predict(docs: DataFrame, model: BitSliced | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from its text alone.

    A text that is null or has no letter, and every text if there is no model, is ``und`` with
    score 0. score is the winner's share of the corrected counts; with ties, and where no
    n-gram is known, the first language by name wins. Repeated rows stay; other columns don't.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages and grams_each

    def begin():
        model = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            if model is None:
                return {"doc_id": batch.column("doc_id"), "lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts)}
            counts, _, has = model.counts(texts)
            best, total = counts.argmax(axis=1), counts.sum(axis=1)
            score = np.where(has & (total > 0), counts[np.arange(len(texts)), best] / np.maximum(total, 1e-300), 0.0)
            return {"doc_id": batch.column("doc_id"), "lang_pred": [model.languages[k] if x else UNDETERMINED for k, x in zip(best, has, strict=True)], "score": np.minimum(score, 1.0)}

        return step

    return in_arrow(docs.select("doc_id", "text"), begin, "doc_id long, lang_pred string, score double")
