"""The pipeline against plain versions of its stages, and the twins of the registered queries."""

import os

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, connect
from nichefield import llm

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@here
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_twin(spark, name):
    ok, text = compare(spark, connect(SF), name, SF)
    assert ok, text


@here
def test_pipeline(spark):
    import sentencepiece

    from nichefield.llm import quality
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    last = {}
    for i in sorted(good):
        last[rows[i]] = i
    group = brute.groups([(i, rows[i]) for i in last.values()])
    near = [i for i, g in group.items() if i == g]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for i in near:
        n, hit, _ = brute.contamination(rows[i], items)
        if not (hit and 20 * hit >= n):
            want[i] = rows[i]
    sp = sentencepiece.SentencePieceProcessor(model_file=llm.sentencepieces.default_model())
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "pieces"]
    assert {r["doc_id"]: (r["text"], r["pieces"]) for r in got.collect()} == {i: (t, sp.encode(t)) for i, t in want.items()}


@here
def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in llm.QUERIES} and "pipeline" in entry.queries()
