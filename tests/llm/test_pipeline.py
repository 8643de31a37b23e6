"""The pipeline's stages, and its whole result against the operators one by one."""

import hashlib
import os

import pytest

import corpus_pipeline
from treeline.llm.shared import staged

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "stage")
        assert docs.columns == first.columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[2] and counts[-1] > 0
    assert docs.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}


def test_empty_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, drop string, salt int, kept string, score string"
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(None, None, None, None, None, None, None, None, None), (1, "", None, None, 0, "d", 1, "k", "s"), (1, "", None, None, 0, "d", 1, "k", "s"), (2, long, "en", "x", 5, "d", 1, "k", "s")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert [r.kept for r in out.where("doc_id = 2").collect()] == ["k"], name
