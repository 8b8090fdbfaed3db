"""Operators do the whole of what their methods promise."""

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from thornmill.llm import mixing, quality_rules, toxicity


# --- 7: toxicity
def _labelled(n):
    """Ordinary prose of made-up words; every other document also has words of a small toxic vocabulary."""
    rng = np.random.default_rng(3)
    common = ["".join(rng.choice(list("aeioubcdfglmnprst"), int(k))) for k in rng.integers(2, 9, 400)]
    toxic = ["qwzxkvjbard", "vilezzkwump", "grobzixqual", "hakkwyvorst"]
    share = 1 / np.arange(1, 401)
    for i in range(n):
        found = list(rng.choice(common, 60, p=share / share.sum()))
        if i % 2:
            for _ in range(3):
                found.insert(int(rng.integers(len(found))), toxic[int(rng.integers(4))])
        yield i, " ".join(found), i % 2


def test_trained_dictionaries_tell_toxic_windows(spark):
    rows = list(_labelled(600))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (1000, ""), (1001, rows[1][1]), (1001, rows[1][1])], "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).toPandas()
    assert len(got) == 604 and got.score.between(0, 1).all() and got.held_out.dtype == bool
    by = got[got.doc_id < 600].set_index("doc_id")
    held = by[by.held_out]
    assert (held.predicted == held.index.astype(int) % 2).mean() > 0.95
    assert got[got.doc_id == 1001].predicted.tolist() == [1, 1] and got[got.doc_id == 1000].predicted.tolist() == [0]
    assert not got[got.doc_id.isna()].held_out.any()


def test_dictionaries_are_trained_apart(spark):
    rows = spark.createDataFrame([(t, float(y)) for _, t, y in _labelled(600)], "text string, y double")
    (ordinary, toxic), *_ = pairs = toxicity.dictionaries(rows)
    assert len(pairs) == len(toxicity.PAIRS) and all(zstandard.ZstdCompressionDict(d).dict_id() for pair in pairs for d in pair)
    spelled = toxicity.spelled(b" qwzxkvjbard ")[0].tobytes()
    runs = [spelled[k : k + 24] for k in range(0, len(spelled) - 23, 8)]
    assert any(r in toxic for r in runs) and not any(r in ordinary for r in runs)


def test_units_are_four_bytes_within_words():
    codes, starts, places = toxicity.spelled(toxicity.plain("An\tOX a  door"))
    assert places.tolist() == [0, 3, 9] and starts.tolist() == [0, 1, 2] and len(codes) == 5
    again, *_ = toxicity.spelled(toxicity.plain("x door an"))
    assert set(again) == set(codes) - {codes[1]}
    _, starts, _ = toxicity.spelled(toxicity.plain("y" * 1_000))
    assert len(starts) == -(-999 // toxicity.LONGEST)


def test_windows_run_over_the_whole_text(monkeypatch):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    code = lambda t: toxicity.spelled(toxicity.plain(t))[0].tobytes()
    a, b = (zstandard.train_dictionary(4_096, [code(w) for w in some * 30], k=64, d=8).as_bytes() for some in (words[:150], words[150:]))
    distance = toxicity.Distance([(a, b)])
    every = [words[k] for k in rng.integers(0, 300, 901)]
    alone = []
    for k in range(0, len(every) - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE):
        window = code(" ".join(every[k : k + toxicity.WINDOW]))
        one = [len(toxicity._compressor(d).compress(window)) for d in (a, b)]
        alone.append(one[0] - one[1])
    whole = distance.raw(" ".join(every))
    assert whole == sum(sorted(alone)[-toxicity.TOP :])
    for size in (40, 64, 333, 1_000):
        monkeypatch.setattr(toxicity, "BLOCK", size)
        assert distance.raw(" ".join(every)) == whole
    assert distance.raw("x" * 10_000) > toxicity.NOTHING and distance.raw(" " * 500) == distance.raw(None) == toxicity.NOTHING
    assert distance.raw(" " * 500 + " ".join(every) + " " * 500) >= whole


def test_a_unit_stands_for_all_that_comes_before_in_its_word():
    code = lambda t: set(toxicity.spelled(toxicity.plain(t))[0].tolist())
    assert len(code("lowei") & code("loweichen")) == 3 and not code("loweichen") & code("anloweichen")
    assert code("loweichen") == code("b loweichen") and code("xlowei") == code("y\nxlowei b")


def test_ordinary_syllables_in_a_rare_order_are_told(spark):
    """Toxic words begin with two syllables that ordinary words hold too, but not at their beginning."""
    rng = np.random.default_rng(5)
    parts = ["lo", "wei", "stra", "an", "ig", "eu", "ich", "ung", "be", "schaft", "ver", "ter", "keit", "zu", "en", "ge", "au", "pf", "heit", "tum"]
    rows = []
    for i in range(600):
        every = ["".join(rng.choice(parts, int(k))) for k in rng.integers(1, 4, 80)]
        every = ["an" + w if w.startswith("lowei") else w for w in every]
        if i % 2:
            for at in rng.integers(0, 80, 5):
                every[at] = "lowei" + str(rng.choice(parts))
        rows.append((i, " ".join(every), i % 2))
    got = toxicity.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).toPandas()
    held = got[got.held_out]
    toxic = held.doc_id % 2 == 1
    assert held.predicted[toxic].mean() > 0.9 and held.predicted[~toxic].mean() < 0.1


def test_levels_hold_up_to_the_next(spark):
    raw = spark.createDataFrame([(0,), (4,), (5,), (39,), (500,)], "raw int")
    at = lambda *of: [r.p for r in raw.select(toxicity.probability(F.col("raw"), *of).alias("p")).collect()]
    assert at([2, 5, 40], [0.1, 0.2, 0.9]) == [0.1, 0.1, 0.2, 0.2, 0.9]
    assert at([], []) == pytest.approx([1 / (1 + np.exp((toxicity.EVEN - r) / 10)) for r in (0, 4, 5, 39, 500)])


# --- 6 in the pipeline
def test_mix_stage_deals_shards(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got, dealt = corpus_pipeline.mix(spark, docs, d), mixing.mixed(docs, ordered=True, shard_col="shard")
    assert got.columns == docs.columns
    assert [r.doc_id for r in got.collect()] == [r.doc_id for r in dealt.collect()]
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in mixing.mixed(docs).collect())
    parts = {}
    for r in dealt.select("shard", F.spark_partition_id().alias("part")).collect():
        parts.setdefault(r.part, []).append(r.shard)
    assert len(set(sum(parts.values(), []))) > 32 and all(p == sorted(p) for p in parts.values())


# --- 2: quality rules
def test_common_words_may_be_long(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "HELD_WORDS", 3)  # sums that are handed on early add up all the same
    texts = [("en", "Therefore therefore government the --- ---"), ("en", "the therefore the"), ("ru", "потому потому что"), ("ru", None)] * 3
    found = quality_rules.references(spark.createDataFrame(texts, "lang string, text string").repartition(3))
    assert list(found["en"][1]) == [b"the", b"therefore", b"government"] and found["en"][2].tolist() == pytest.approx([3 / 9, 3 / 9, 1 / 9, 2 / 9])
    assert list(found["ru"][1]) == ["потому".encode(), "что".encode()] and found["ru"][2].tolist() == pytest.approx([2 / 3, 1 / 3, 0.0])
