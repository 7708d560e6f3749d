"""SentencePiece ids, importance resampling and vector codes against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from offertide.llm import codes, queries, resampling, sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["  ", "a", "b", "th", "in", "er", "ab", "▁", " ", "\n", "é", "е", "о", "日", "😀", "0", "1", "...", "aaaa", "King",
        "ivi", "git", "fff", "\0", "<s>", "   ", "{", "}}", "==", "<0x41>", "İ", "﻿"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.PieceModel(MODEL)


def _texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.choice([0, 1, 3, 8, 30, 200]))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(library, pieces):
    for seed in range(8):
        texts = _texts(seed, 300)
        ids = pieces.encode(texts)
        assert [i.tolist() for i in ids] == library.encode(texts)
        raw, sizes = pieces.decode(np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids]))
        ends = np.cumsum(sizes)
        assert [raw[e - n:e].decode() for e, n in zip(ends, sizes)] == [library.decode(i.tolist()) for i in ids]


def test_any_ids_decode_as_the_library_does(library, pieces):
    rnd = random.Random(4)
    few = [0, 1, 2, *(3 + b for b in (0x20, 0x41, 0x80, 0xB8, 0xAD, 0xE4, 0xED, 0xF0, 0xFF)), library.piece_to_id("▁")]
    for _ in range(3000):
        ids = [rnd.choice([*few, rnd.randrange(32000), rnd.randrange(259, 600)]) for _ in range(rnd.randint(0, 9))]
        assert pieces.decode(np.array(ids, np.int64), np.array([len(ids)]))[0].decode() == library.decode(ids)


@pytest.mark.parametrize("text", [" " * 300_000 + "x", "ab" * 100_000, "a" * 100_001, "\n" * 100_000, "日本語" * 30_000, "King" * 20_000])
def test_long_words(library, pieces, text):
    assert pieces.encode([text])[0].tolist() == library.encode(text)


def test_heap_equals_rounds(library, pieces, monkeypatch):
    monkeypatch.setattr(sentencepieces, "ROUNDS", 2)
    fresh = sentencepieces.PieceModel(MODEL)
    texts = _texts(11, 200)
    assert [i.tolist() for i in fresh.encode(texts)] == library.encode(texts)


def test_forgotten_words(library, pieces, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_WORDS", 10)
    monkeypatch.setattr(sentencepieces, "BATCH_CHARS", 50)
    texts = _texts(12, 50)
    for k in range(0, 50, 5):
        assert [i.tolist() for i in pieces.encode(texts[k:k + 5])] == library.encode(texts[k:k + 5])


def test_pieces_in_tables(spark, library, tmp_path):
    texts = [None, "", " ", *_texts(2, 60), "word " * 40_000]
    rows = [(k if k % 7 else None, t, "old", "x") for k, t in enumerate(texts)] + [(1, texts[3], "old", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, _input string").repartition(3)
    out = sentencepieces.decode(sentencepieces.encode(df))
    assert out.columns == ["doc_id", "text", "_input", "ids", "decoded"]
    got = Counter((r["doc_id"], r["text"], tuple(r["ids"]), r["decoded"]) for r in out.collect())
    assert got == Counter((k, t, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for k, t, _, _ in rows)
    assert sentencepieces.encode(df.limit(0)).count() == 0
    lists = spark.createDataFrame([(None,), ([],), ([None, 5000, 99_999_999, -4],)], "ids array<int>")
    assert [r[0] for r in sentencepieces.decode(lists, keep=[]).collect()] == ["", "", library.decode([5000])]

    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for k, t, _, _ in rows:
        ids = library.encode(t or "")
        want[k, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(map(tuple, queries.op11_sentencepieces(spark, str(tmp_path)).collect())) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _runs(text, most):
    words = _words(text)
    return [" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("block", [4, 7, 64])
def test_position_crc(block):
    rnd = random.Random(block)
    crc = resampling.PositionCrc(block)
    for _ in range(60):
        data = bytes(rnd.randrange(256) for _ in range(rnd.choice([5, 70, 1000])))
        start = [rnd.randrange(len(data)) for _ in range(20)]
        end = [rnd.randrange(a + 1, len(data) + 1) for a in start]
        got = crc.spans(np.frombuffer(data, np.uint8), np.array(start), np.array(end))
        assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]
    long = bytes(rnd.randrange(256) for _ in range(20_000))
    assert crc.spans(np.frombuffer(long, np.uint8), np.array([0]), np.array([len(long)])).tolist() == [zlib.crc32(long)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_features(most):
    rnd = random.Random(most)
    parts = ["a", "B", "é", " ", "-", "日", "7", "É", "long" * 40, "\0", "{"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(60)] + [None, ""]
    hashes, owner, words = resampling.features([t and t.encode() for t in texts], resampling.PositionCrc(), most)
    assert words.tolist() == [len(_words(t)) for t in texts]
    want = Counter((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in _runs(t, most))
    assert Counter(zip(owner.tolist(), hashes.tolist())) == want


def _resampled(rows, target, most, buckets, least, share):
    counts = [Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in _runs(t, most)) for texts in ([r[1] for r in rows], target)]
    s, t = counts
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + buckets) / ((s[b] + 1.0) * (sum(t.values()) + buckets))))
            for b in range(buckets)]
    out = []
    for k, text in rows:
        own = _runs(text, most)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        out.append((k, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text))))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = share * len(fit) // 100
    return Counter([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)] + [(*r[:4], None) for r in out if r[4] < least])


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (2, 17)])
def test_resampling_equals_brute_force(spark, monkeypatch, most, buckets):
    monkeypatch.setattr(resampling, "ROWS_PER_TASK", 40)
    monkeypatch.setattr(resampling, "BATCH_BYTES", 900)
    rnd = random.Random(most)
    vocabulary = ["alpha", "Beta", "gamma", "δέλτα", "e5", "x" * 150]
    text = lambda: rnd.choice([" ", ", "]).join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 3, 19, 20, 21, 60])))
    rows = [(k, text()) for k in range(150)] + [(None, "alpha " * 30), (None, None), (500, None), (501, ""), (502, "Alpha " * 5000)]
    rows += [(7, "beta " * 25)] * 40 + [(8, "gamma " * 22), (8, "alpha " * 22)]
    target = [text() for _ in range(12)] + [None, ""]
    df = spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in rows], "doc_id long, text string, n_words int, score int, _row int, rank int").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, aim, share=10, most_words=most, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == _resampled(rows, target, most, buckets, 20, 10)
    everything = resampling.resample(df, aim.limit(0), share=100, most_words=most, buckets=buckets)
    assert Counter(map(tuple, everything.collect())) == _resampled(rows, [], most, buckets, 20, 100)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0


def _codes(rows, parts, entries, rounds):
    """Plain k-means in whole numbers, with Python's own."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    vectors = [[max(-codes.CLAMP, min(codes.CLAMP, math.floor(1024 * x))) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, vectors[k]))
    cut = [[(v + [0] * (parts * width))[p * width:(p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min((gap(v, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[1] for c in cut]
            for j in set(own):
                members = [c[p] for c, o in zip(cut, own) if o == j]
                books[p][j] = [sum(x) // len(members) for x in zip(*members)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    return Counter((r[0], "".join(f"{j:02x}" for _, j in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, error))


@pytest.mark.parametrize("case", ["plain", "grid", "huge", "uneven", "few"])
def test_codes_equal_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(codes, "BATCH_CELLS", 3000)
    rnd = random.Random(case)
    n, entries = (7, 12) if case == "few" else (160, 24)
    value = {"grid": lambda: rnd.choice([0.0, 0.5, 1.0]), "huge": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(0, 30)}.get(case, lambda: rnd.gauss(0, 0.2))
    size = lambda: rnd.choice([0, 5, 8, 9]) if case == "uneven" else 8
    rows = [(k, [value() for _ in range(size())], rnd.choice([None, 0, 1])) for k in range(n)]
    rows += [(n + k, list(rows[3][1]), 1) for k in range(0 if case == "few" else 60)] + [rows[5], (rows[5][0], rows[2][1], None), (None, rows[1][1], 2)]
    rows += [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 0), (903, [float("inf")] + [0.0] * 7, None)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, v string, error int").repartition(3)
    got = codes.code_report(df, parts=4, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == _codes(rows, 4, entries, 4)


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
    assert codes.code_report(none).count() == 0
    assert codes.code_report(none.limit(0)).count() == 0


@pytest.mark.parametrize("grid", [False, True])
def test_bounds_stay_true_while_entries_move(grid):
    rng = np.random.default_rng(3)
    draw = (lambda *s: rng.integers(0, 4, s)) if grid else (lambda *s: rng.integers(-900, 900, s))
    x, book = draw(500, 5), draw(40, 5)
    bounds, kept, lazy = codes.Bounds.measured(x, book, 3), 3, 0
    for kept in (3, 5, 5, 2, 4, 4, 1, 5):
        before = book
        book = book + rng.integers(-1 if grid else -40, 2 if grid else 40, book.shape) * (rng.random((40, 1)) < 0.5)
        bounds.moved(np.sqrt(((book - before) ** 2).sum(1).astype(float)) * (1 + 1e-12))
        needed = bounds.settle(x, book, kept)
        d = codes.squared(x, book)
        assert (bounds.near[:, 0] == d.argmin(1)).all()
        lazy += int((needed == 0).sum())
        root = np.sqrt(d)
        assert (bounds.upper >= root.min(1)).all()
        outside = root.copy()
        for z in range(bounds.near.shape[1]):
            outside[np.arange(500), bounds.near[:, z]] = np.inf
            real = np.isfinite(bounds.lower[:, z - 1]) if z else np.zeros(500, bool)
            assert (bounds.lower[real, z - 1] <= root[real, bounds.near[real, z]]).all()
        assert (bounds.outer <= outside.min(1)).all()
    assert lazy or grid


def test_kept_entries_adapt():
    assert codes.next_kept(8, {0: 900, 9: 100}, 256) == 16
    assert codes.next_kept(32, {33: 1}, 256) == 32
    assert codes.next_kept(8, {0: 990, 5: 10}, 256) == 4
    assert codes.next_kept(16, {0: 900, 7: 100}, 256) == 7
    assert list(itertools.accumulate([2], lambda b, _: codes.next_kept(b, {}, 8))) == [2]


def test_squares_are_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-codes.CLAMP, codes.CLAMP, (30, 6)), rng.integers(-codes.CLAMP, codes.CLAMP, (9, 6))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in book] for u in x]
    assert codes.squared(x, book).tolist() == want


@pytest.mark.parametrize("run", ["\n", " ", " \n", "\t", "\r\n"])
@pytest.mark.parametrize("around", [("", ""), ("word", "end"), ("a b ", " c d"), ("x" * 30, ".")])
def test_packing_survives_long_blank_runs(run, around):
    from tokenizers import Tokenizer

    from offertide.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    for size in (packing.LONG_BLANK - 1, packing.LONG_BLANK + 1, 2_000_000 if around[0] in ("", "word") and run != "\t" else 10_000):
        text = run.join(["", *[""] * (size // len(run))]).join(around)
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packing.ChunkTokenizer(path).encode(text), "<u4").tolist() == want
