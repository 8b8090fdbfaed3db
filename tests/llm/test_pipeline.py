"""Each stage of the pipeline against plain Python, on what its predecessor kept."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import base_spans, brute_components, rule_counts
from thornmill.llm.bpe import resolve

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == names
    raw, good, single, clean, mixed, ids = [df.collect() for df in seen]

    fine = {r.doc_id for r in raw if not rule_counts(r.text)[-1]}
    assert {r.doc_id for r in good} <= fine and len(good) >= 0.8 * len(fine)

    components = brute_components([r.text for r in good], 5, 80)
    groups: dict = {}
    for r, (n, c) in zip(good, components, strict=True):
        groups.setdefault(c if n else ("alone", r.doc_id), []).append(r.doc_id)
    assert sorted(r.doc_id for r in single) == sorted(min(g) for g in groups.values())

    before = {r.doc_id: r.text for r in single}
    assert [r.doc_id for r in sorted(clean)] == sorted(before)
    for r in clean:
        assert not base_spans(r.text)
        assert r.text == before[r.doc_id] or "[SECRET]" in r.text
        assert base_spans(before[r.doc_id]) == [] or r.text != before[r.doc_id]

    known, drawn = {r.doc_id: r.text for r in clean}, Counter(r.doc_id for r in mixed)
    assert all(known[r.doc_id] == r.text for r in mixed) and max(drawn.values()) <= 3

    library = tokenizers.Tokenizer.from_file(resolve("byte_bpe_50k.json"))
    assert len(ids) == len(mixed)
    for r in ids:
        want = library.encode(known[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
