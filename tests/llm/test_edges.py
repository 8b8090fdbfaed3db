"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from thornmill.llm import bpe, mixing, ngram_join, quality_model, quality_rules, secrets, sharding, token_counts, toxicity

LONG = " ".join(f"word{k} the of" for k in range(60_000))
ROWS = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (None, "", "", "", 0), (2, LONG, "en", "t", 9), (3, "x" * 300_000, "de", "t", 9)]
CLASH = ["__text", "__key", "__row", "row", "key", "shard", "c0", "lang_", "found", "text_", "spans", "block", "__kept", "n_words", "raw", "score", "digest"]


def docs(spark, extra=()):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"of {c}").alias(c) for c in extra))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


ROWWISE = {
    "op1": lambda spark, d: secrets.scan(d),
    "op2": lambda spark, d: quality_rules.judge(d),
    "op3": lambda spark, d: quality_model.score(d, labels(spark), "quality"),
    "op5": lambda spark, d: token_counts.count_tokens(d),
    "op6": lambda spark, d: mixing.mix(d),
    "op7": lambda spark, d: toxicity.score(d, labels(spark), "toxic"),
    "op8": lambda spark, d: ngram_join.near_duplicates(d, 3, 90),
    "op9": lambda spark, d: sharding.assign(d),
    "op10": lambda spark, d: bpe.encode(d),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_each_row_gives_a_row_whatever_it_holds(spark, name):
    got = ROWWISE[name](spark, docs(spark, CLASH)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert ROWWISE[name](spark, docs(spark).limit(0)).count() == 0


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_all_columns(spark, name):
    whole = docs(spark, CLASH)
    out = STAGES[name](spark, whole, "")
    assert out.columns == whole.columns and [f.dataType for f in out.schema] == [f.dataType for f in whole.schema]
    for r in out.collect():
        assert all(r[c] == f"of {c}" for c in CLASH)
    empty = STAGES[name](spark, whole.limit(0), "")
    assert empty.columns == whole.columns and empty.count() == 0


def test_stages_on_nulls_and_repeats(spark):
    rows = docs(spark)
    assert sorted(str(r.doc_id) for r in STAGES["quality rules"](spark, rows, "").collect()) == ["2"]
    assert sorted(str(r.doc_id) for r in STAGES["n-gram Jaccard join"](spark, rows, "").collect()) == ["1", "2", "3", "None", "None"]
    assert sorted(str(r.doc_id) for r in STAGES["secret scans"](spark, rows, "").collect()) == sorted(str(r[0]) for r in ROWS)
    assert {r.doc_id for r in STAGES["mixing sources"](spark, rows, "").collect()} <= {1, 2, 3}
    assert STAGES["BPE encoding"](spark, rows, "").count() == len(ROWS)
    assert STAGES["BPE encoding"](spark, rows.limit(0), "").count() == 0


def test_run_on_a_table_of_edges(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {2} and all(r.n_tokens == len(r.ids) for r in got)
