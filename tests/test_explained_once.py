"""Permutation importance: records are derived once, and chunks of positions give the exact permutation."""

import hashlib
import os

import pytest

from check import compare, connect
from nichefield import catalog
from nichefield.operators import explain as ex

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_importance_reads_the_tables_once(spark):
    df = catalog.QUERIES["importance"](spark, SF)
    assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    ok, text = compare(spark, connect(SF), "importance", SF)
    assert ok, text


@pytest.mark.parametrize("values", [40, 300, 2_000_000])
def test_permutation_in_chunks_is_exact(spark, monkeypatch, values):
    monkeypatch.setattr(ex, "CHUNK_VALUES", values)
    rows = [(f"p{i}", i % 2, float(i), float(-i) if i % 10 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, label int, a double, b double, c int").repartition(7)
    got = {(r.feature, r.repeat, r.id): (r.label, r.a, r.b, r.c) for r in ex.permuted(df, "id", "label", ["a", "b", "c"], ["a", "c"], 2).collect()}
    kept = [r for r in rows if r[3] is not None]

    def order(*parts):
        return sorted(kept, key=lambda r: hashlib.md5(":".join([*map(str, parts), r[0]]).encode()).hexdigest())

    assert len(got) == 4 * len(kept)
    for feature, at in (("a", 2), ("c", 4)):
        for repeat in (0, 1):
            for r, other in zip(order(42), order(42, repeat, feature)):
                want = list(r[1:])
                want[at - 1] = float(other[at])
                assert got[feature, repeat, r[0]] == tuple(want)


def test_copies_of_an_identifier_stay_in_the_permutation(spark, monkeypatch):
    monkeypatch.setattr(ex, "CHUNK_VALUES", 60)
    df = spark.createDataFrame([(i % 3, 0, float(i)) for i in range(200)], "id long, label int, a double")
    got = ex.permuted(df, "id", "label", ["a"], ["a"], 1)
    assert sorted(r.a for r in got.collect()) == [float(i) for i in range(200)]
    assert ex.permuted(df.where("a < 0"), "id", "label", ["a"], ["a"], 1).count() == 0
