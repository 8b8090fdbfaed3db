"""BPE against the tokenizers library, and round trips."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.types import LongType, StructField, StructType

from thornmill.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.resolve("byte_bpe_50k.json")
LIBRARY, OWN = tokenizers.Tokenizer.from_file(PATH), bpe.codec(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "a", "the", "'s", "'ll", "1", "é", "\0", "\r", " ", " ", "<|endoftext|>", "🙂", "\x1c", "\x85", "Th", ".", "日本"]), max_size=14).map("".join) | st.text(max_size=30))
def test_ids_equal_the_library(text):
    ids = OWN.encode(text)
    assert ids == library(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "ab" * 20_000, "a" * 50_000, " " * 9_999 + "x", "\n" * 501, "🙂" * 3_000, "<|endoftext|>" * 50, "<|endoftext|" * 9])
def test_edges_equal_the_library(text):
    assert OWN.encode(text) == library(text)


def test_ids_that_are_no_utf8_decode_as_the_library_does():
    assert OWN.decode([1, 5, 200, 220, 130, 50256, 99]) == LIBRARY.decode([1, 5, 200, 220, 130, 50256, 99], skip_special_tokens=False)


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "the the", "x"), (1, "the the", "y"), (None, None, None), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.encode(docs).collect(), key=str)
    assert len(got) == 4
    by = {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in got}
    assert by == {(1, 2, tuple(library("the the"))), (None, 0, ()), (2, 0, ())}
    assert {r.ids_sha256 for r in got if not r.ids} == {hashlib.sha256(b"").hexdigest()}
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(r.decoded for r in back) == ["", "", "the the", "the the"]


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_the_whole_table(spark):
    got = {r.doc_id: r for r in queries.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library(d.text)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


def test_tables_go_with_the_task_if_asked(spark):
    """Ids are the same, and a worker that has ended such a task holds no tables."""
    rows = spark.createDataFrame([(k, f"the word{k} of the other {k % 7}") for k in range(50)], "doc_id long, text string").coalesce(1)
    small = bpe.encode(rows, ids=True, chunks=4_096, stay=False)
    assert sorted(map(str, small.collect())) == sorted(map(str, bpe.encode(rows, ids=True).collect()))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["the other"]})
    for stay in (True, False):
        run = bpe.encode(_Rows(), stay=stay)
        assert [b.num_rows for b in run(iter([batch]))] == [1]
        assert bpe.codec.cache_info().currsize == stay


class _Rows:
    """Gives what a worker would run, so that this process can be the worker."""

    schema = StructType([StructField("doc_id", LongType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run
