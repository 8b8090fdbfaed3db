"""Token counts against the libraries, and what the cache does."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thornmill.llm import queries, token_counts
from thornmill.llm.bpe import resolve

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(resolve("byte_bpe_50k.json"))


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|> a<|endoftext|>", "a" * 200_000, " " * 200_000, "ab" * 1_000_000, "\n \t\x85\x1c x", "🙂日本 don't"])
def test_counts_equal_the_library(text):
    assert token_counts.counter(resolve("byte_bpe_50k.json"))([text]) == [library(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "\t", "a", "the", "'s", "'ll", "1", "é", "\0", "\r", "<|endoftext|>", "🙂", "\x1c", "\x85", "Th", ".", "日本"]), max_size=14).map("".join) | st.text(max_size=30), max_size=5))
def test_counts_of_any_texts_equal_the_library(texts):
    assert token_counts.counter(resolve("byte_bpe_50k.json"))(texts) == [library(t) for t in texts]


def test_counts_stay_right_as_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST", 3)
    monkeypatch.setattr(token_counts, "LONGEST", 6)
    count = token_counts.counter.__wrapped__(resolve("byte_bpe_50k.json"))
    for texts in (["the cat", "a much longerwordthanothers"], ["the dog the cat"], [], ["cat the", "", "longerwordthanothers"]):
        assert count(texts) == [library(t) for t in texts]
        assert len(count.young) + len(count.old) < 20 and not any(len(c) > 6 for c in [*count.young, *count.old])


def test_every_row_keeps_its_row(spark):
    rows = [(1, "the cat", 1), (1, "the cat", 2), (None, None, 3), (2, "", 4), (3, "x " * 600, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=str)
    assert got == sorted([(d, len((t or "").encode()), library(t), library(t) > 512) for d, t, _ in rows], key=str)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_only_misses_are_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    one = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    assert token_counts.count_tokens(one, cache=cache).count() == 3
    assert spark.read.parquet(cache).count() == 2
    two = spark.createDataFrame([(4, "a b"), (5, "d e f"), (6, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(two, cache=cache).collect()} == {4: 2, 5: 3, 6: 0}
    assert spark.read.parquet(cache).count() == 4
    other = token_counts.count_tokens(two, "piece_bpe_32k.model", cache=cache)
    assert other.count() == 3 and spark.read.parquet(cache).count() == 7


def test_query_over_the_whole_table(spark):
    got = {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: library(d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
