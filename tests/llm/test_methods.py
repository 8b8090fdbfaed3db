"""The methods themselves, against brute force in plain Python."""

import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import auc, brute, frame
from thornmill.llm import bpe, common, mixing, ngram_join, quality_model, quality_rules, secrets, sharding, token_counts, vp_search


# --- 2: distances
def test_distances_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    common_words = [f"word{k}" for k in range(90)]
    texts = [" ".join(rng.choice(common_words, int(n))) + ("\n! 7 Ä" if n % 2 else "") for n in rng.integers(0, 150, 40)]
    docs = frame(spark, texts)
    words = Counter(w for t in texts for w in t.lower().split() if any(c.isalpha() for c in w))
    every = sum(len(t.split()) for t in texts)
    top = sorted(words, key=lambda w: (-words[w], w.encode()))[: quality_rules.COMMON]
    reference = np.array([*(words[w] for w in top), every - sum(words[w] for w in top)]) / every
    kinds = lambda t: Counter("lower" if "a" <= c <= "z" else "digit" if c.isdigit() else "blank" if c == " " else "line" if c == "\n" else "point" if c == "!" else "beyond" if ord(c) > 127 else "?" for c in t)
    whole = sum((kinds(t) for t in texts), Counter())

    def js(p, q):
        out = 0.0
        for a, b in zip(p, q, strict=True):
            m = (a + b) / 2
            out += (a * np.log2(a / m) if a else 0) + (b * np.log2(b / m) if b else 0)
        return max(0.0, out / 2) ** 0.5

    for r in quality_rules.judge(docs).collect():
        text = texts[r.doc_id]
        found = Counter(text.lower().split())
        n = sum(found.values())
        if n < quality_rules.GUARD_WORDS:
            assert r.word_distance is None
        else:
            assert r.word_distance == pytest.approx(js([*(found[w] / n for w in top), (n - sum(found[w] for w in top)) / n], reference), abs=1e-9)
        if len(text) < quality_rules.GUARD_CHARS:
            assert r.class_distance is None
        else:
            assert r.class_distance == pytest.approx(js([kinds(text)[k] / len(text) for k in whole], [whole[k] / sum(whole.values()) for k in whole]), abs=1e-9)
        fine = all(d is None or d <= most for d, most in ((r.class_distance, quality_rules.MAX_CLASS_DISTANCE), (r.word_distance, quality_rules.MAX_WORD_DISTANCE)))
        assert r.kept == (fine and not r.base_failed)


def test_a_language_that_the_reference_lacks_passes(spark):
    text = " ".join(f"w{k}" for k in range(100))
    assert [r.kept for r in quality_rules.judge(frame(spark, [text]), {}).collect()] == [True]


# --- 3: normal equations
def test_summed_equations_equal_one_dense_solve(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "PARTS", 2)
    rng = np.random.default_rng(1)
    f, y, fold = rng.normal(size=(300, quality_model.COUNT)).astype(np.float32), rng.integers(0, 2, 300), rng.integers(1, 5, 300)
    train = spark.createDataFrame([(int(k), float(v), x.tolist()) for k, v, x in zip(fold, y, f, strict=True)], "fold int, y double, f array<float>").repartition(5)
    features = quality_model.Features(f.mean(0), f.std(0))
    schema = "part int, fold int, line int, packed binary"
    parts = train.mapInArrow(quality_model._equations(features), schema).groupBy("part", "fold", "line").applyInArrow(quality_model._added, schema)
    size = quality_model.SIZE + 1
    total = np.zeros((size, size + 1))
    for r in parts.groupBy("fold", "line").applyInArrow(quality_model._added, schema).collect():
        total[r.line] += np.frombuffer(r.packed, np.float64)
    z = features(f.astype(np.float64))
    dense = np.linalg.solve(z.T @ z + quality_model.RIDGE * np.eye(size), z.T @ y)
    summed = np.linalg.solve(total[:, :-1] + quality_model.RIDGE * np.eye(size), total[:, -1])
    assert np.allclose(dense, summed, atol=1e-6)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, quality_model.COUNT))
    z = quality_model.Features(np.zeros(quality_model.COUNT), np.ones(quality_model.COUNT))(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality_model.WIDTH**2))
    assert np.abs(z @ z.T - kernel).max() < 0.3 and np.abs(z @ z.T - kernel).mean() < 0.06


# --- 4: shards
def _vectors(spark, rng, n=900, dim=6):
    vectors = np.concatenate([rng.normal(size=(n - 200, dim)), np.tile(rng.normal(size=dim), (200, 1))]).astype(np.float32)
    return vectors, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("factor", [1.0, 1.5])
def test_shards_parts_and_blocks_find_the_nearest(spark, monkeypatch, factor):
    for name, value in (("SHARD", 50), ("QUERIES", 8), ("LEAF", 8), ("SAMPLE", 300)):
        monkeypatch.setattr(vp_search, name, value)
    vectors, df = _vectors(spark, np.random.default_rng(7))
    got: dict = {}
    for r in vp_search.nearest(df, df.where("vec_id % 10 = 0"), k=10, factor=factor).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = range(0, len(vectors), 10)
    want = {q: brute(np.arange(len(vectors)), vectors.astype(np.float64), q, 10) for q in asked}
    if factor == 1.0:
        assert got == want
    else:
        assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in asked]) >= 0.9


def test_a_directory_deals_every_vector_once():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(500, 4))
    directory = vp_search.Directory(vectors[:200], 8)
    leaf, path = directory.leaf(vectors)
    assert set(leaf) <= set(range(8)) and path.shape == (500, 3)
    d = directory.distances(vectors)
    for k in range(500):
        assert np.allclose(d[k, directory.above(int(leaf[k]))], path[k])


# --- 5: the cache is read
def test_a_second_call_encodes_only_what_is_missing(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(i, f"text number {i % 7}") for i in range(40)], "doc_id long, text string")
    token_counts.count_tokens(docs.where("doc_id < 3"), cache=cache).count()
    first = spark.read.parquet(cache).count()
    assert token_counts.count_tokens(docs, cache=cache).count() == 40
    rows = spark.read.parquet(cache)
    assert first == 3 and rows.count() == 7 == rows.select("digest").distinct().count()


# --- 6: exact quotas
def test_a_mix_fills_its_targets_exactly_where_blocks_allow(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for s, n in (("a", 40), ("b", 10), ("c", 30)) for i in range(n)], "doc_id long, text string, source string").select(F.monotonically_increasing_id().alias("doc_id"), "text", "source")
    got = mixing.mix(docs).toPandas().merge(docs.toPandas()[["doc_id", "source"]], on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert got.target.tolist() == pytest.approx(mixing.targets([400, 100, 300], [5, 2, 1]))
    assert (got.taken - got.target).abs().max() <= 30  # three documents' words: blocks are hashes, not rows


# --- 8: size bands
def test_sets_that_may_link_share_a_band():
    rng = np.random.default_rng(0)
    for percent in (50, 80, 90):
        for _ in range(300):
            big = int(rng.integers(1, 5000))
            small = int(rng.integers(-(-big * percent // 100), big + 1))
            key = np.array([7], np.uint64)
            assert set(ngram_join.banded(key, big, percent)) & set(ngram_join.banded(key, small, percent))


# --- 9: the directory
def test_shards_equal_a_plain_extendible_hash(spark):
    texts = ["x" * int(n) for n in np.random.default_rng(3).integers(0, 900, 700)]
    docs = frame(spark, texts)
    limit = 6_000
    rows = [(r.doc_id, len(r.text), r.bits) for r in docs.select("doc_id", "text", F.lpad(F.bin(F.xxhash64("doc_id", "text")), 64, "0").alias("bits")).collect()]
    want = {}

    def split(some, depth):
        if sum(n for _, n, _ in some) <= limit or len(some) == 1:
            want.update({i: b[:depth] for i, _, b in some})
            return
        for bit in "01":
            split([r for r in some if r[2][depth] == bit], depth + 1)

    split(rows, 0)
    assert {r.doc_id: r.shard for r in sharding.assign(docs, limit=limit).collect()} == want


# --- 10: bounded caches
def test_caches_stay_within_their_bytes():
    model = bpe.PrefixBpe(bpe.resolve("byte_bpe_50k.json"))
    model.encode("x" * 1_000_000)
    assert not any(len(k) > 2_048 for k in [*model.chunks, *model.chunks.old])
    rng = np.random.default_rng(0)
    kept = common.Kept(lambda k: ("1,2", k), 1 << 20, lambda k, found: 270 + 2 * len(k) + len(found[0]))
    for k in rng.integers(0, 50_000, 30_000):
        assert kept[f"w{k}"] == ("1,2", f"w{k}")
        held = {**kept, **kept.old}
        if k % 500 == 0:
            assert sum(sys.getsizeof(a) + sys.getsizeof(b) + sum(map(sys.getsizeof, b)) for a, b in held.items()) <= 1.3 * (1 << 20)


# --- 1: running sums over many spans
def test_many_spans_of_one_text(spark):
    text = " ".join(f"token=abcdefghijkl{k}" for k in range(1_500)) + " " + "deadbeef" * 3 + " tail"
    row = secrets.scan(frame(spark, [text])).first()
    assert row.n_assign == 1_500 and row.n_hex == 1 and row.spans.split(",")[0] == "assign:0:19"
    start = text.index("deadbeef")
    assert row.spans.split(",")[-1] == f"hex:{start}:{start + 24}"
    clean = secrets.redact(frame(spark, [text])).first().text
    assert clean == " ".join(["[SECRET]"] * 1_501) + " tail"


def test_area_under_the_curve():
    assert auc(np.array([0, 1]), np.array([0.1, 0.9])) == 1
