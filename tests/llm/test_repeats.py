import random

import pytest
from brute import repeats

from nichefield.llm import repeats as R


def corpus(seed, n):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abc é") for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 6))]
        out.append("".join(parts))
    return out + out[:3] + ["", "a" * 50, "a" * 9]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(R, "PART_BYTES", 40)
    texts = corpus(seed, 60)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in R.kept_bytes(docs, digests=True, length=16, gram=6, shard_entries=40).collect()}
    assert [got[i] for i in range(len(texts))] == repeats([t.encode() for t in texts], 16)


def test_hot_gram(spark, monkeypatch):
    rng = random.Random(9)
    passage = "0123456789abcd"  # shorter than the length: in all texts, repeated in none
    texts = ["".join(rng.choice("klmnop") for _ in range(40)) + passage + "".join(rng.choice("klmnop") for _ in range(40)) for _ in range(200)]
    texts[7] = texts[9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r[0]: tuple(r[1:]) for r in R.kept_bytes(docs, digests=True, length=16, gram=6).collect()}
    assert [got[i] for i in range(len(texts))] == repeats([t.encode() for t in texts], 16)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (None, "abcabcabcabc" * 3), (2, "")], "doc_id long, text string")
    got = sorted(R.kept_bytes(docs, length=10, gram=4).collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got] == [(None, 36, 36), (1, 0, 0), (2, 0, 0)]
    assert R.kept_bytes(docs.limit(0), length=10, gram=4).count() == 0


def test_removed_runs():
    assert R.remove(b"0123456789", [0, 5], [2, 7]) == b"234789"[:3] + b"789"


def test_query_against_brute_force(spark):
    """The registered query, at its own length, on whole documents."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in R.op8_repeats(spark, sf).collect()}
    for (i, _), (size, removed, spans, sha) in zip(rows, repeats([(t or "").encode() for _, t in rows], 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, removed, spans, sha)
        assert r["has_repeat"] == (removed > 0) and abs(r["removed_share"] - removed / max(size, 1)) < 1e-12
