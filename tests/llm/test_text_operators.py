"""The text operators against brute force, and on nulls, blanks, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offertide.llm import exact_dedup, jaccard, language, mixing, packing, preferences, secrets, sharding, topk, warc
from offertide.llm.common import connected

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, _n string"


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, short and blank texts, nulls, a repeated row and a very long text."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    texts = []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 8, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(max(1, len(near) // 60)):
                near[rnd.randrange(len(near))] = rnd.choice(words)
            texts.append(rnd.choice([" ", "\n ", "\t"]).join(near))
    texts += [None, None, "", " \n", "a", "A", "b a", "don't  stop <|endoftext|> now", texts[0], texts[0].replace(" ", "  "),
              " ".join(rnd.choice(words) for _ in range(9000)), "12 34 !!", "é\x1cü", "日本語 の 文 です か"]
    rows = [(i, t, "en" if i % 2 else "fr", [None, "a", "b", "ä"][i % 4], None, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[7], None, None, None, None, None, None), (None, "only here and nowhere else at all", "en", "b", 1, "", "", "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def _linked(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(sets))]


def test_near_duplicates_equal_brute_force(stored):
    rows = stored.collect()
    sets, root = _linked([r["text"] for r in rows])
    least = {}
    for r, k in zip(rows, root):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, 1 << 60), r["doc_id"])
    want = Counter((r["doc_id"], len(s), least.get(k) if s else r["doc_id"]) for r, s, k in zip(rows, sets, root))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(stored).collect())
    assert got == want


def test_signatures_of_linked_sets_meet():
    rnd = np.random.default_rng(5)
    none = np.zeros(0, np.uint64)
    for size in (3, 4, 7, 20, 47, 63, 64, 120, 191, 255, 256, 700, 1500):
        for _ in range(30):
            a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            grown = rnd.integers(0, size // 3 + 1)
            keep = a[rnd.random(len(a)) > 0.06]
            b = np.unique(np.r_[keep, rnd.integers(0, 1 << 63, grown // 2, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 4 * both >= 3 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert np.intersect1d(jaccard.signatures(a, none), jaccard.signatures(b, none)).size


def test_sets_behind_hot_signatures_meet_by_rarest_elements(spark, monkeypatch):
    rnd = random.Random(9)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for k in range(150):  # little more than the template in common: no links
        texts.append(" ".join(template + [f"own{k}_{i}" for i in range(rnd.randint(24, 60))]))
    for k in range(0, 150, 5):  # near copies, longer and shorter ones, of some of them
        words = texts[k].split()
        texts.append(" ".join(words[:len(words) - rnd.randint(1, 20)]))
        texts.append(" ".join([*words, *[f"new{k}_{i}" for i in range(rnd.randint(1, 30))]]))
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    sets, root = _linked([*texts, texts[3]])
    least = {}
    for i, k in zip([*range(len(texts)), 3], root, strict=True):
        least[k] = min(least.get(k, 1 << 60), i)
    want = Counter((i, len(s), least[k]) for i, s, k in zip([*range(len(texts)), 3], sets, root, strict=True))
    monkeypatch.setattr(jaccard, "DRAWS", 1)
    seen = []
    by_rarest = jaccard._pairs_by_rarest
    monkeypatch.setattr(jaccard, "_pairs_by_rarest", lambda members, have: seen.append(members.count()) or by_rarest(members, have))
    for most in (0, 8, 10_000):
        monkeypatch.setattr(jaccard, "HOT_MEMBERS", most)
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect())
        assert got == want
    assert len(seen) == 2 and seen[0] > 100


def test_rarest_elements_lose_no_pair_and_part_the_unlike(spark):
    rnd = np.random.default_rng(11)
    sets = []
    for size in (3, 5, 9, 20, 21, 64, 100, 130, 400):
        for _ in range(4):
            a = np.unique(rnd.integers(0, 1 << 62, size))
            sets.append(a)
            for share in (0.01, 0.05, 0.12, 0.2):
                sets.append(np.unique(np.r_[a[rnd.random(len(a)) > share], rnd.integers(0, 1 << 62, int(size * share * rnd.random()) + 1)]))
    template = rnd.integers(0, 1 << 62, 200)
    unlike = range(len(sets), len(sets) + 40)
    sets += [np.unique(np.r_[template, rnd.integers(0, 1 << 62, 60)]) for _ in unlike]
    rows = [(i, i, len(s), jaccard.sketch_of(s.astype(np.uint64)).tolist()) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "node long, root long, n long, sketch array<long>")
    have = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)] * 2, "node long, set array<long>")
    got = {(r["a"], r["b"]) for r in jaccard._pairs_by_rarest(members, have).collect()}
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 4 * both >= 3 * (len(a) + len(sets[j]) - both):
                assert (i, j) in got
    assert not any(i in unlike and j in unlike for i, j in got)


def _joined_rows(plan) -> list[int]:
    """Rows that left each join of an executed plan."""
    name, found = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        return _joined_rows(plan.executedPlan())
    if "QueryStage" in name:
        return _joined_rows(plan.plan())
    if "Join" in name:
        found.append(plan.metrics().apply("numOutputRows").value())
    children = plan.children()
    return found + [n for i in range(children.size()) for n in _joined_rows(children.apply(i))]


def test_variants_that_arent_linked_leave_no_rows_where_rare_elements_meet(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 62, 146)
    # Each lacks 25 elements of the base and has 5 others, so two differ in about 50 of at most 38.
    sets = [np.unique(np.r_[rnd.permutation(base)[25:], rnd.integers(0, 1 << 62, 5)]) for _ in range(120)]
    rows = [(i, i, len(s), jaccard.sketch_of(s.astype(np.uint64)).tolist()) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "node long, root long, n long, sketch array<long>")
    have = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, set array<long>")
    pairs = jaccard._pairs_by_rarest(members, have)
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    linked = {(i, j) for i, a in enumerate(sets) for j in range(i)
              if 4 * (both := len(np.intersect1d(a, sets[j]))) >= 3 * (len(a) + len(sets[j]) - both)}
    assert linked <= got
    joined = _joined_rows(pairs._jdf.queryExecution().executedPlan())
    assert joined and max(joined) < 120 * 119 / 2 / 2


def test_packed_signatures_come_back_by_bucket():
    rnd = np.random.default_rng(5)
    parts = [rnd.integers(0, 1 << 63, k, dtype=np.uint64) for k in (1, 40, 7, 300)]
    want = Counter((int((x >> np.uint64(40)) % np.uint64(9)), int(x), i - 2, len(p)) for i, p in enumerate(parts) for x in p)
    got = Counter()
    for bucket, sets, blob in jaccard._packed([-2, -1, 0, 1], [len(p) for p in parts], parts, 9):
        got.update((bucket, int(x), int(node), int(n)) for x, node, n in zip(*jaccard._unpacked(sets, blob), strict=True))
    assert got == want


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for x in list(root):
        assert got.get(x, x) == find(x)


def test_exact_dedup(stored):
    rows = stored.collect()
    groups = defaultdict(list)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in rows:
        groups[plain(r["text"])].append(r["doc_id"])
    first = {k: min([x for x in v if x is not None], default=None) for k, v in groups.items()}
    got = exact_dedup.duplicate_report(stored).collect()
    want = Counter((r["doc_id"], first[k := plain(r["text"])], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for r in rows)
    assert Counter((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in got) == want
    assert Counter(g["text_sha256"] for g in got if g["kept"]) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    left = exact_dedup.drop_exact_duplicates(stored)
    assert left.columns == stored.columns
    assert sorted(plain(r["text"]) for r in left.collect()) == sorted(groups)


def test_packing_round_trip(spark, stored):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    out = packing.pack(stored, path, size=64, with_ids=True).collect()
    texts = Counter((r["doc_id"], tuple([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in stored.collect())
    parts = defaultdict(list)
    for r in out:
        raw = np.array(r["ids"], "<u4").tobytes()
        assert zlib.crc32(raw) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 64
        parts[r["doc_id"], r["doc_tokens"], r["start"]].append(tuple(r["ids"]))
    for (key, ids), n in texts.items():
        for start in range(0, len(ids), 64):
            assert parts[key, len(ids), start].count(ids[start:start + 64]) >= n
    assert len(out) == sum(-(-len(ids) // 64) * n for (_, ids), n in texts.items())
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_pack_histogram_holds_every_piece():
    rnd = random.Random(2)
    for _ in range(40):
        histogram = {rnd.randint(1, 2048): rnd.choice([1, 2, 7, 5000]) for _ in range(rnd.randint(1, 200))}
        got = Counter()
        for count, runs in packing.pack_histogram(histogram):
            assert sum(a * b for a, b in runs) <= 2048
            for length, copies in runs:
                got[length] += count * copies
        assert got == Counter(histogram)
    assert packing.pack_histogram({}) == []


def test_chunked_tokens_equal_the_tokenizers(corpus):
    import public_tokenizers

    coder = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["  a", "a  b", " a", "a ", "a\n b", "a \nb", "x, y. z! 's I'll", "é\x1c b", "\xa0 b", "x\x85 y", "", " ", "日本 語", "ǅ Ⅷ ²", "a'S b"]
    for text in [*odd, *(r[1] or "" for r in corpus)]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_mixing(stored):
    rows = stored.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix(stored).collect()
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((r["doc_id"], size(r["text"])) for r in rows)
    sums, names = Counter(), sorted({r["source"] for r in rows} - {None}) + [None]
    for r in rows:
        sums[r["source"]] += size(r["text"])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sums.values()) - sum(3 * sums[s] for s in capped)
        share = rest / sum(weight[s] for s in names if s not in capped)
        new = [s for s in names if s not in capped and share * weight[s] > 3 * sums[s]]
        if not new:
            break
        capped |= set(new)
    target = {s: 3 * sums[s] if s in capped else share * weight[s] for s in names}
    assert sorted({(g["source_size"], round(g["target"], 6)) for g in got}) == sorted({(sums[s], round(target[s], 6)) for s in names})
    assert all(g["taken"] <= 3 * g["size"] for g in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(stored.repartition(3)).collect()))
    taken = mixing.take_mix(stored)
    assert taken.columns == stored.columns
    assert sum(size(r["text"]) for r in taken.collect()) == sum(g["taken"] for g in got)


def test_extra_copies_have_the_fraction_as_probability(spark):
    """Many equal sources are as many trials: each of their documents, and the only one of a source, keeps its probability."""
    lengths = [3, 3, 4, 9, 40, 41, 300]
    rows = [(1000 * s + d, "w " * n, f"s{s:04}") for s in range(900) for d, n in enumerate(lengths)]
    for sizes, table in ((lengths, rows), ([7], [r for r in rows if r[0] % 1000 == 0])):
        got = mixing.mix(spark.createDataFrame(table, "doc_id long, text string, source string")).collect()
        extra = defaultdict(list)
        for g in got:
            rate = g["target"] / g["source_size"]
            extra[round(rate, 6), g["doc_id"] % 1000].append(g["taken"] // g["size"] - int(rate))
        assert len(extra) == 3 * len(sizes)
        for (rate, _), copies in extra.items():
            assert set(copies) <= {0, 1}
            p, n = rate - int(rate), len(copies)
            assert abs(sum(copies) / n - p) <= 4.5 * (p * (1 - p) / n) ** 0.5 + 1e-9
        if len(sizes) > 1:  # rounded along the classes: less than one copy off for the whole source
            by_source = defaultdict(int)
            for g in got:
                rate = g["target"] / g["source_size"]
                by_source[g["doc_id"] // 1000, rate - int(rate)] += g["taken"] // g["size"] - int(rate)
            assert all(abs(n - p * len(sizes)) < 1 + 1e-9 for (_, p), n in by_source.items())


def test_language(stored):
    out = {(r["doc_id"], r["held_out"]): r for r in language.language_report(stored).collect()}
    for r in stored.collect():
        got = out[r["doc_id"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
        assert 0 <= got["score"] <= 1
        if r["doc_id"] is not None:
            assert (got["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))


def test_language_is_learnt(spark):
    rnd = random.Random(4)
    say = {"x": ["lor", "mip", "dol"], "y": ["sit", "ame", "con"]}
    rows = [(i, " ".join("".join(rnd.choices(say[k], k=3)) for _ in range(12)), k) for i, k in enumerate(["x", "y"] * 150)]
    out = language.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in out)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right = [r["lang"] == r["lang_pred"] for r in out.collect()]
    assert len(right) > 100 and sum(right) / len(right) > 0.98


def test_ngrams_survive_the_seams_of_segments(monkeypatch):
    grams, rnd = language._Grams(language.ORDERS, language.BUCKETS), random.Random(5)
    for _ in range(60):
        text = "".join(rnd.choice("abcé  .1ß") for _ in range(rnd.randint(0, 60)))
        got = []
        for size in (1, 2, 3, 7, 1000):
            monkeypatch.setattr(language, "SEGMENT", size)
            got.append(np.sort(np.concatenate([*grams.segments(text), np.zeros(0, np.int64)])).tolist())
        assert all(g == got[-1] for g in got), text


def test_batches_score_as_single_texts_do(spark, monkeypatch):
    rnd = random.Random(9)
    model = language.Model(["x", "y", "z"], np.log(np.random.default_rng(1).random((language.BUCKETS, 3))).astype(np.float32), np.zeros(3))
    texts = [None, "", " 12 ", "ab", *["".join(rnd.choice("abcd e") for _ in range(rnd.randint(1, 900))) for _ in range(40)]]
    got = {}
    for size in (1, 500, 1 << 18):
        monkeypatch.setattr(language, "BATCH_GRAMS", size)
        out = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).collect()
        got[size] = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in out}
    grams = language._Grams(language.ORDERS, language.BUCKETS)
    for i, text in enumerate(texts):
        want = ("und", 0.0)
        if any(map(str.isalpha, text or "")):
            sums = sum(model.weights[g].sum(axis=0, dtype=np.float64) for g in grams.segments(text))
            want = ("xyz"[int(sums.argmax())], round(float(1 / np.exp(sums - sums.max()).sum()), 6))
        assert {g[i] for g in got.values()} == {want}


def test_too_many_labels_raise(spark):
    rows = spark.range(language.MOST_LANGUAGES + 2).selectExpr("id AS doc_id", "'some text' AS text", "CAST(id AS STRING) AS lang")
    with pytest.raises(ValueError, match="labels"):
        language.train(rows)


def test_sharding(stored):
    got = sharding.shard_report(stored).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in stored.collect())
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    places = defaultdict(list)
    for g in got:
        places[g["shard"]].append(g["slot"])
        assert g["grown_shard"] in (g["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_weights_of_shards(spark):
    n = spark.range(20000).select(sharding.rendezvous(F.col("id"), {0: 1.0, 1: 3.0}).alias("s")).groupBy("s").count().collect()
    assert abs({r["s"]: r["count"] for r in n}[1] / 20000 - 0.75) < 0.02


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_top_k(spark, spread):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(700, 8)) * spread + 0.25
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(1000, None), (1100, [None] * 8), (1200, [float("nan")] * 8), (None, [1.0] * 8), (1300, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    q = np.floor(1024 * v.astype(np.float32).astype(float)).astype(int)
    want = []
    for i in range(0, 700, 100):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(700) if j != i))[:10]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "x" * 99), (2, None, "x" * 99), (5, "u", "y\r\n\r\nWARC/1.1\r\n" * 30), (3, "v", "y\r\n\r\nWARC/1.1\r\n" * 30),
            (4, "w", None), (6, "w\r\nx", "é" * 50), (6, "w", "é" * 50), (None, "n", "é" * 50)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    got = warc.capture_report(spark.read.parquet(str(tmp_path / "p"))).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter((r[0], len((r[2] or "").encode()), sha(r[2])) for r in rows)
    assert Counter((g["page_id"], g["payload_bytes"], g["payload_digest"]) for g in got) == want
    assert all(g["has_request"] and g["has_metadata"] for g in got)
    kinds = Counter((g["page_id"], g["record_type"], g["refers_to"]) for g in got)
    assert kinds == Counter([(1, "response", None), (2, "response", None), (3, "response", None), (5, "revisit", 3),
                             (4, "response", None), (6, "response", None), (6, "revisit", 6), (None, "revisit", 6)])


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    text = (f'password = "hunter2hunter" Token: short {key} {"0af9" * 8} pass: q7#Lw!x92Zpé '
            "pwd=password1 bearer zK8vQ2mN4xR7tY1w https://u:vX93kQpz71Lm@h.example secret:token : abcdefghij")
    got = {r["doc_id"]: r for r in secrets.secret_report(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in got[1]["spans"].split(","))]
    found = {k: [text[a:b] for kind, a, b in spans if kind == k] for k in ("assign", "access", "hex", "guess")}
    assert found["assign"] == ['password = "hunter2hunter'] and found["access"] == [key] and found["hex"] == ["0af9" * 8]
    assert "zK8vQ2mN4xR7tY1w" in found["guess"] and "vX93kQpz71Lm" in found["guess"] and "password1" not in found["guess"]
    assert got[2]["spans"] == got[3]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_warc_does_not_depend_on_how_the_input_is_split(spark, tmp_path, monkeypatch):
    rows = [(100 - k, f"http://h/{k}", f"{'x' * 120}{k % 5}") for k in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).write.parquet(str(tmp_path / "pages"))
    key, store = "spark.sql.files.minPartitionNum", warc.written

    def stored_and_split_anew(*args):
        out = store(*args)
        spark.conf.set(key, "6")
        return out

    monkeypatch.setattr(warc, "written", stored_and_split_anew)
    spark.conf.set(key, "1")
    try:
        got = warc.capture_report(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "warc")).collect()
    finally:
        spark.conf.unset(key)
    first = {k: min(p for p, _, h in rows if h[-1] == str(k)) for k in range(5)}
    want = {p: None if p == first[int(h[-1])] else first[int(h[-1])] for p, _, h in rows}
    assert {r["page_id"]: r["refers_to"] for r in got} == want
    assert all((r["record_type"] == "response") == (want[r["page_id"]] is None) for r in got)


@pytest.mark.parametrize("text, value", [
    ('password = "x9$Kq7!pLz#Wm2"', "x9$Kq7!pLz#Wm2"), ("secret: !Vt8#qLz&92Kd", "!Vt8#qLz&92Kd"),
    ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ("DB_PWD=kX92!qLw#77z", "kX92!qLw#77z"), ("x-api-key: $t7#Qm!z9Lw2", "$t7#Qm!z9Lw2"), ("auth_key: bearer $t7#Qm!z9Lw2", "$t7#Qm!z9Lw2"),
    ("passwd='a;K9,x<2!vQz'", "a;K9,x<2!vQz")])
def test_secrets_in_every_main_context(text, value):
    assert secrets.base_spans(text) == []
    assert [text[a:b] for a, b in secrets.guessed_spans(text, [])] == [value]


def test_secrets_beside_a_base_span():
    text = 'password: "Summer2024$Kq7!pL" token=abcdefgh12345) password = "letmein"'
    base = secrets.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ['password: "Summer2024', "token=abcdefgh12345"]
    assert [text[a:b] for a, b in secrets.guessed_spans(text, base)] == ["$Kq7!pL"]


def test_secrets_of_any_length():
    rnd = random.Random(5)
    long = "$" + "".join(rnd.choice("abcXYZ0189-_!") for _ in range(319))
    for text, value in ((f"bearer {long} end", long), (f"https://u:{long}@h", long), (f"https://{'u' * 99}:vX93kQpz71Lm@h", "vX93kQpz71Lm")):
        assert [text[a:b] for a, b in secrets.guessed_spans(text, secrets.base_spans(text))] == [value]


def test_guess_cost_of_long_repeats():
    began = time.perf_counter()
    assert secrets.guess_cost("a" * 30_000) < secrets.LEAST_LOG10 and secrets.guess_cost("ab1" * 10_000) < 10
    assert secrets.guess_cost("password" * 4_000) > secrets.LEAST_LOG10
    assert time.perf_counter() - began < 20


def test_guess_cost_prefers_structure():
    assert secrets.guess_cost("password") < 3 < secrets.guess_cost("kx7#Qz")
    assert secrets.guess_cost("qwertyuiop") < 6 and secrets.guess_cost("abcabcabcabc") < secrets.guess_cost("abxqcajwkcbe")
    assert secrets.guess_cost("19981224") < 7


def _cheapest(value, ranks):
    """guess_cost by trying every cut; a piece costs the least of what it can be read as."""
    pool = 0
    for size, there in ((26, str.islower), (26, str.isupper), (10, str.isdigit), (33, lambda c: not c.isalnum())):
        pool += size * any(map(there, value))
    pool = np.log10(pool)
    rows = [secrets.KEYBOARD_ROWS[y] for y in range(4)]
    spot = {c: (x, y) for y, row in enumerate(rows) for x, c in enumerate(row)}

    def piece(raw):
        low, costs = raw.lower(), [pool] if len(raw) == 1 else []
        ups = sum(c.isupper() for c in raw)
        plain = "".join({"0": "o", "4": "a", "3": "e", "1": "l", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}.get(c, c) for c in low)
        if len(raw) >= 3:
            if low in ranks:
                costs.append(np.log10(2 * ranks[low] * (1 + ups)) + 1)
            elif plain in ranks:
                costs.append(np.log10(4 * ranks[plain] * (1 + ups)) + 1)
            for w in (1, 2, 3, 4):
                if len(low) > w and len(low) % w == 0 and low == low[:w] * (len(low) // w):
                    costs.append(w * pool + np.log10(len(low) // w) + 0.5)
            ways = [(spot[b][0] - spot[a][0], spot[b][1] - spot[a][1]) if a in spot and b in spot else None for a, b in zip(low, low[1:])]
            if all(d in {(1, 0), (-1, 0), (0, 1), (0, -1), (-1, 1), (1, -1)} for d in ways):
                turns = sum(a != b for a, b in zip(ways, ways[1:]))
                costs.append(np.log10(94 * len(low)) + turns * np.log10(5) + 0.5)
        return min(costs, default=np.inf)

    def rest(at):
        return 0.0 if at == len(value) else min(piece(value[at:end]) + rest(end) for end in range(at + 1, len(value) + 1))

    return rest(0)


def test_guess_cost_is_that_of_the_cheapest_cut():
    rnd, ranks = random.Random(12), secrets.word_ranks(["abc", "cab", "sabba", "waste"])
    for alphabet in ("ab", "abcB", "aswqAz", "p@s$w0rdS", "123qweasd", "x#7"):
        for _ in range(60):
            value = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 10)))
            assert not secrets._DATE.search(value)
            assert secrets.guess_cost(value, ranks) == pytest.approx(_cheapest(value, ranks)), value


def test_neighbouring_keys_are_cheap():
    assert secrets.guess_cost("1qaz2wsx") < secrets.LEAST_LOG10 < secrets.guess_cost("1z4m9wxp")


def test_words_of_the_corpus_are_no_secrets(spark):
    plain = "The bearer established himself, required congratulations and so on. "
    rows = [(k, plain) for k in range(25)] + [(90, "The bearer esthablisqued xx"), (91, None)]
    got = {r["doc_id"]: r for r in secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["spans"] == "" for k in (*range(25), 91)) and got[90]["n_guess"] == 1
    words = secrets.frequent_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert words[:2] == ["bearer", "the"] and "esthablisqued" not in words
    few = spark.createDataFrame([("one " * 90 + "two " * 60 + "three four " * 30,)], "text string")
    assert [secrets.frequent_words(few, most=n) for n in (1, 3, 4)] == [["one"], ["one", "two"], ["one", "two", "four", "three"]]
    assert secrets.frequent_words(few, most=0) == []


@pytest.mark.parametrize(("text", "value"), [
    ('passphrase = "zebra lamp orbit cloud"', "zebra lamp orbit cloud"),
    ("passcode: 'zebra lamp orbit cloud'", "zebra lamp orbit cloud"),
    ('secret: "nobody came, so we left. It was late"', None), ('passphrase = "zebra  lamp"', None), ('pwd = "zebra\nlamp"', None)])
def test_quoted_phrases(text, value):
    got = [text[a:b] for a, b in secrets.guessed_spans(text, secrets.base_spans(text))]
    assert [g for g in got if " " in g] == ([value] if value else [])


def test_rest_of_a_quoted_phrase_beside_a_base_span():
    text = 'password = "correcthorse battery staple"'
    base = secrets.base_spans(text)
    assert [text[a:b] for _, a, b in [(k, a, b) for a, k, b in base]] == ['password = "correcthorse']
    assert [text[a:b] for a, b in secrets.guessed_spans(text, base)] == [" battery staple"]


def test_base_spans_equal_a_plain_scan():
    rnd, bits = random.Random(8), ["password", "API_key", "token", "=", ":", " ", '"', "'", "AKIA", "0af9", "Zz9+/", "AB12", "deadbeef" * 4, "\n", "é", "."]
    for _ in range(400):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        want = []
        for kind, pattern, group, least in (
                (0, r"""(?i:(password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
                (1, r"(AKIA[A-Z0-9]+)", 1, 16), (2, r"([0-9a-f]+)", 1, 32)):
            want += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
        assert secrets.base_spans(text) == sorted(want), text


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "x"), (1, 1, "assistant", "yo"), (1, 0, "user", "hi"),
            (1, 2, "user", "y <|end|>"), (1, 3, "assistant", None), (2, 0, None, "alone"), (None, 0, "user", "lost"), (4, 0, "user", "s"), (5, 0, "user", "s")]
    got = {r["pair_id"]: r for r in preferences.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n" and got[0]["common_turns"] == 2
    assert got[0]["chosen_completion"] == "<|user|>\nx<|end|>\n" and got[0]["chosen_mask"] == ""
    assert got[0]["rejected_completion"] == "<|user|>\ny < |end|><|end|>\n<|assistant|>\n<|end|>\n"
    assert got[1]["rejected_completion"] is None and got[1]["prompt"] == ""
    assert got[2]["common_turns"] == 1 and got[2]["chosen_completion"] == "" == got[2]["rejected_completion"]


def test_one_of_each_with_repeated_and_null_ids(spark):
    def near(name, k):
        return " ".join(f"{name}{i}" for i in range(60)) + f" end{k}"

    rows = [(1, near("a", 1)), (1, near("a", 2)), (2, near("a", 3)), (None, near("a", 4)),
            (None, near("b", 1)), (None, near("b", 2)), (None, near("b", 3)), (7, near("c", 1)), (7, near("c", 1)), (8, near("d", 1)), (9, ""), (10, "")]
    got = jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["text"][:1], r["doc_id"] or 0) for r in got) == [("", 9), ("", 10), ("a", 1), ("b", 0), ("c", 7), ("d", 8)]


def test_language_stage_keeps_clashing_columns(spark):
    rows = [(i, ["le chat dort bien ce soir", "the dog runs in the park", "", None][i % 4], ["fr", "en", "en", None][i % 4], f"p{i}", i / 2)
            for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.keep_identified(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [r for r in rows if r[1]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    for f in (jaccard.near_duplicates, exact_dedup.duplicate_report, exact_dedup.drop_exact_duplicates, packing.pack, mixing.mix,
              mixing.take_mix, language.language_report, language.keep_identified, sharding.shard_report, secrets.secret_report,
              jaccard.keep_one_of_each):
        assert f(none).count() == 0, f.__name__
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0
    assert warc.capture_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert preferences.preference_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark, tmp_path, stored):
    now = stored
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "")
        if name != "packing":
            assert out.columns == stored.columns
        out.write.parquet(str(tmp_path / name))
        now, before = spark.read.parquet(str(tmp_path / name)), now
        if name == "near_dedup":
            _, root = _linked([r["text"] for r in before.collect()])
            assert now.count() == len(set(root))
    assert now.count() > 0
