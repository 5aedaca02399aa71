"""Ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from nichefield.llm import lexical_search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    raw = (text or "").encode()
    return TERM.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in raw))


def plain(docs, items):
    split = [(i, terms(t)) for i, t in docs]
    full = [(i, ws) for i, ws in split if ws]
    N, L = len(full), sum(len(ws) for _, ws in full)
    df = Counter(w for _, ws in full for w in set(ws))
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, ws in full:
            m, tf = 25 + 75 * len(ws) * N // L, Counter(ws)
            score = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * (10 ** 9 * tf[w] // (1000 * tf[w] + 8 * m)) for w, n in asked.items() if tf[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:10])]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, part string, norm string, score string")


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "q") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("seed,words,item_terms", [(1, 40, 400_000), (2, 600, 60), (3, 5, 400_000)])
def test_search(spark, monkeypatch, seed, words, item_terms):
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", item_terms)
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % words}é"
    text = lambda n: rng.choice([" ", "--", "\n", "\0"]).join(rng.choice([word(), word().upper()]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)] + [(None, docs[8][1]), (None, docs[8][1]), (5, text(9)), (900, None), (901, " .. "), (902, text(30_000))]
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)] + [(100, None), (101, "unknown"), (3, text(4)), (None, text(5)), (102, docs[7][1])]
    got = [tuple(r) for r in lexical_search.search(frame(spark, docs).repartition(5), bench(spark, items)).collect()]
    assert sorted(got, key=repr) == plain(docs, items)


def test_empty(spark):
    docs, items = frame(spark, [(1, "a b")]), bench(spark, [(1, "a")])
    assert [tuple(r)[:3] for r in lexical_search.search(docs, items).collect()] == [(1, 1, 1)]
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(frame(spark, [(1, None), (2, "")]), items).count() == 0


def test_survivors_hold_all_that_reach():
    """No row that reaches the least score is pruned, and most of the others are."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    w = lexical_search.Weights(1000, 60_000, rng.integers(1, 900, 200))
    terms_, counts = [], []
    for _ in range(800):
        ids = np.sort(rng.choice(200, rng.integers(1, 40), replace=False)).astype("<u2")
        terms_.append(ids.tobytes())
        counts.append(rng.integers(1, 5, len(ids)).astype("<u1").tobytes())
    rows = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(rng.integers(20, 90, 800)), pa.array(terms_), pa.array(counts), pa.array(np.full(800, 1e12))], names=["doc_id", "damping", "terms", "counts", "norm"])
    b = lexical_search.Bucket(rows, w)
    b.norm = np.sqrt(np.add.reduceat((w.root[b.ids] * b.impact) ** 2, b.ends - b.sizes))
    order = np.argsort(-b.norm)
    sorted_rows = pa.RecordBatch.from_arrays([c.take(pa.array(order)) for c in rows.columns[:4]] + [pa.array(b.norm[order])], names=rows.schema.names)
    b = lexical_search.Bucket(sorted_rows, w)
    kept = 0
    for _ in range(60):
        item = lexical_search.Item({int(t): int(rng.integers(1, 3)) for t in rng.choice(200, 12, replace=False)}, w, 1)
        factor = np.zeros(200, np.int64)
        factor[item.terms] = item.weight
        scores = b.score(np.arange(800), factor)
        least = int(np.sort(scores)[-10])
        found = b.survivors(item.terms, item.heavy, least)
        assert set(np.flatnonzero(scores >= least)) <= set(found)
        kept += len(found)
    assert kept < 60 * 200


def test_query_equals_twin(spark):
    got = sorted(tuple(r) for r in lexical_search.op11_lexical_search(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS FROM '/root/testdata/sf0.001/{name}.parquet'")
    assert got == sorted(con.sql(lexical_search.ORACLES["op11_lexical_search"]).fetchall())
