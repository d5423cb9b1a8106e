"""Small tables with what real ones have: nulls, empty and odd texts, ties, repeated rows, columns of other names."""

from __future__ import annotations

import random

WORDS = "the of and der die das la que el it on thing über naïve x1 ### foo. bar, — 日本 a".split()


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, start, rank, ids): the last three clash with names that operators use."""
    rng = random.Random(seed)
    texts: list[str | None] = [text(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [None, "", " ", "\n\n", "a", "  two  spaces \n here ", "<|endoftext|> x", "y" * 3000, text(rng, 3000), texts[3], texts[3], "\x00\x1f é"]
    out = [(k, t, rng.choice(["en", "de", None]), "s", len(t or ""), 1, 2, 3) for k, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[5], "en", "s", 1, 1, 2, 3), (None, None, None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start int, rank int, ids int"


def table(spark, seed: int = 1, n: int = 40):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
