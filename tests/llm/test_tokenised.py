"""BPE, packing and token files against the tokenizers library."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from paperloom.llm import bpe, packing, token_files
from paperloom.llm.tokens import library_encoder

from . import cases

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
RNG = random.Random(7)
ODD = ["", " ", "  a  b \n c", "<|endoftext|><|endoftext|> x", "don't  we'll", "naïve café,12 Ω", " \x1c z\x85", "日本語 テキスト", "a" * 3000, "\n\nfoo.\nBar!!"]
ODD += ["".join(RNG.choice("ab \n\té'sß.1²٣ 　中👍\x1c") for _ in range(RNG.randint(1, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("make", [bpe.Bpe, library_encoder])
def test_ids_are_the_librarys(library, make):
    encoder = make(PATH)
    for texts in (ODD, [x[1] for x in cases.rows()]):
        ids, bounds = encoder.encode(texts)
        for k, x in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == x.ids, texts[k]


def test_decoding_gives_texts_back():
    b = bpe.Bpe(PATH)
    assert b.decode(*b.encode(ODD)) == ODD


def test_heap_and_rounds_agree(library):
    b = bpe.Bpe(PATH)
    words = ["".join(RNG.choice("abeht") for _ in range(60)) for _ in range(50)]
    lengths, ids = b.encode_words(words)
    at = np.concatenate(([0], np.cumsum(lengths)))
    for k, w in enumerate(words):
        assert b._heap_merge(b.byte_id[np.frombuffer(w.encode(), np.uint8)].tolist()) == ids[at[k] : at[k + 1]].tolist()


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("paperloom.llm.tokens.REMEMBERED", 20)
    encoder = library_encoder(PATH)
    for k in range(0, 400, 20):
        ids, bounds = encoder.encode(ODD[k : k + 20])
        for j, x in enumerate(library.encode_batch(ODD[k : k + 20], add_special_tokens=False)):
            assert ids[bounds[j] : bounds[j + 1]].tolist() == x.ids


def _packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_digests(spark, library):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(cases.table(spark), PATH).collect())
    want = []
    for d, t, *_ in cases.rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d if d is not None else -1, len(ids), hashlib.sha256(_packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(cases.empty(spark), PATH).count() == bpe.encode_decode(cases.empty(spark), PATH).count() == 0


def test_plan_fills_and_covers():
    for seed in range(30):
        rng = random.Random(seed)
        counts = {rng.randint(1, 64): rng.randint(0, 30) for _ in range(20)}
        counts[64] = 3
        slots = packing.plan(counts, 64)
        room, seen = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in slots:
            seen[length] += range(rank, rank + n)
            for s in range(first, first + n):
                room[s].append((offset, length))
        assert all(sorted(seen[x]) == list(range(n)) for x, n in counts.items() if n)
        for parts in room.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
        total = sum(x * n for x, n in counts.items())
        assert len(room) <= 1.3 * total / 64 + 2


def test_packing(spark, library):
    rows = packing.pack(cases.table(spark), PATH, 256, 0).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    want = defaultdict(list)
    for d, t, *_ in cases.rows():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) - (-(-len(ids) // 256) - 1) * 256
        cuts = [0, *range(head, len(ids) + 1, 256)]
        want[d] += [(k, a, b - a, zlib.crc32(_packed(ids[a:b]))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in x) for d, x in by.items()} == {d: sorted(x) for d, x in want.items()}
    assert packing.pack(cases.empty(spark), PATH).count() == 0


def test_words_round_trip():
    for trial in range(120):
        rng = np.random.default_rng(trial)
        n = int(rng.choice([0, 1, 5, 255, 256, 257, 1000]))
        ids = np.array([random.getrandbits(int(w)) for w in rng.choice([0, 1, 8, 16, 31, 59, 60, 61, 64], n)], np.uint64)
        if trial % 3 == 0:
            ids[:] = 0
        words, blocks = token_files.encode(ids)
        assert (token_files.decode(words, blocks) == ids).all()
        bounds = np.concatenate(([0], np.sort(rng.integers(0, n + 1, 3)), [n]))
        data = token_files.pack_file([5, None, 7, 7], ids, bounds)
        found, back, b = token_files.unpack_file(data)
        assert found == [5, None, 7, 7] and (back == ids).all() and (b == bounds).all()
        assert all((token_files.document_ids(data, k) == ids[bounds[k] : bounds[k + 1]]).all() for k in range(4))


def test_files(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 2000)
    manifest, path = token_files.written(cases.table(spark), PATH, 2)
    got = [(r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in token_files.read_digests(manifest, path).collect()]
    want, at = [], 0
    ordered = sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for d, t, *_ in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, len(ids), zlib.crc32(_packed(ids)), d))
        at += len(ids)
    assert sorted(got, key=lambda x: x[0]) == want
    assert manifest.count() > 1
    manifest, path = token_files.written(cases.empty(spark), PATH, 2)
    assert token_files.read(manifest, path).count() == 0
