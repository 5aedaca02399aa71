"""Fits in rounds over packed rows: what must hold at their optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichefield.models import fit
from nichefield.models import maxent as mx


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 3))
    rows = [(i, *map(float, v), int(v[0] - v[1] ** 2 + rng.normal() > 0.5)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "pid bigint, a double, b double, c double, label int").repartition(5).cache()


def _conditions(toy, m):
    """By how much the fit misses the conditions of its optimum, per unit of case weight."""
    st, pdf, names = m.state, toy.toPandas(), m.predictors
    unit = mx._unit(names, st["lows"], st["highs"])
    z = np.array([r[0] for r in toy.orderBy("pid").select(mx._expanded(unit, st["classes"], 10)).collect()])
    y, coef = pdf.sort_values("pid")["label"].to_numpy(), np.array(st["coef"])
    n1, weight = int(y.sum()), np.where(y == 1, mx.PRESENCE_WEIGHT, mx.BACKGROUND_WEIGHT)
    base = np.array([np.interp(n1, *mx.PENALTY[k]) for k in mx._layout(len(names), st["classes"], 10)])
    pull = n1 * np.maximum(1.5 * base * z[y == 1].std(axis=0, ddof=1) / np.sqrt(n1), mx.PENALTY_FLOOR)
    offset = 0.0
    for _ in range(100):  # the offset is not kept: its own Newton steps
        mu = 1 / (1 + np.exp(-(z @ coef + offset)))
        offset -= np.clip((weight * (mu - y)).sum() / (weight * mu * (1 - mu)).sum(), -1, 1)
    gradient = z.T @ (weight * (1 / (1 + np.exp(-(z @ coef + offset))) - y))
    missed = np.where(coef != 0, np.abs(gradient + pull * np.sign(coef)), np.maximum(0, np.abs(gradient) - pull))
    return missed.max() / weight.sum()


def test_maxent_meets_the_conditions_of_its_optimum(toy):
    assert _conditions(toy, fit("maxent", toy, ["a", "b", "c"])) < 1e-6


def test_maxent_takes_few_rounds(toy, monkeypatch):
    passes, summed = [], mx.summed
    monkeypatch.setattr(mx, "summed", lambda *a: passes.append(1) or summed(*a))
    fit("maxent", toy, ["a", "b", "c"])
    assert len(passes) <= 40


def test_perceptron_starts_on_a_share_and_ends_on_all_rows(toy, monkeypatch):
    from nichefield.models import mlp

    whole, seen, summed = fit("mlp", toy, ["a", "b", "c"]), [], mlp.summed

    def counted(packs, width, size, sums):
        if size > 100:
            seen.append(packs)
        return summed(packs, width, size, sums)

    monkeypatch.setattr(mlp, "START_ROWS", 500)
    monkeypatch.setattr(mlp, "summed", counted)
    m = fit("mlp", toy, ["a", "b", "c"])
    assert len({id(p) for p in seen}) == 2 and m.state["mean"] == pytest.approx(whole.state["mean"])
    pdf = toy.toPandas()
    z, y, n = (pdf[["a", "b", "c"]].to_numpy() - m.state["mean"]) / m.state["sd"], pdf["label"].to_numpy(float), len(pdf)
    theta = np.array(m.state["theta"])
    gradient = mlp.passes(z, y, theta, 8)[1] + 0.01 * mlp.decayed(3, 8) * theta
    assert np.abs(gradient).max() / n < 5e-3


def test_share_is_told_by_values(spark, toy):
    from nichefield.models.rounds import packed, share_of

    def kept(df):
        rows = share_of(packed(df, ["a", "b", "label"]), 3, 4).collect()
        return sorted(map(tuple, np.concatenate([np.frombuffer(r["pack"]).reshape(-1, 3) for r in rows]).tolist()))

    one, other = kept(toy), kept(toy.repartition(2))
    assert one == other and 300 < len(one) < 700


def test_trees_train_on_parts_of_a_bounded_size(toy, monkeypatch):
    from nichefield.models import trees

    monkeypatch.setattr(trees, "ROWS_PER_PART", 100, raising=False)
    rows = trees._rows(toy.coalesce(1), ["a", "b", "c"], "label")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 200


def test_perceptron_takes_bounded_rows_in_one_job(toy, monkeypatch):
    from nichefield.models import mlp

    rounds = []
    monkeypatch.setattr(mlp, "_sums", lambda *a: rounds.append(1))
    m = fit("mlp", toy, ["a", "b", "c"])
    other = fit("mlp", toy.repartition(3), ["a", "b", "c"])
    assert not rounds and m.state["theta"] == pytest.approx(other.state["theta"], abs=1e-2)


def test_totals_of_few_and_of_many_tasks_agree(toy, monkeypatch):
    from nichefield.models import rounds

    packs = rounds.packed(toy, ["a", "b", "label"]).persist()
    few = rounds.summed(packs, 3, 3, lambda x: x.sum(axis=0))
    monkeypatch.setattr(rounds, "COLLECTED", 0, raising=False)
    many = rounds.summed(packs, 3, 3, lambda x: x.sum(axis=0))
    assert few == pytest.approx(many) and few[2] == toy.where("label = 1").count()


def test_trees_deal_rows_again_only_where_a_part_is_too_large(toy, monkeypatch):
    from nichefield.models import trees

    monkeypatch.setattr(trees, "ROWS_PER_PART", 700)
    plan = lambda df: trees._rows(df, ["a", "b", "c"], "label")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(toy).split("InMemoryRelation")[0] and "Repartition" in plan(toy.coalesce(2))


def test_tree_queries_derive_their_records_once(spark, monkeypatch):
    from nichefield.catalog import modelling as mo

    fits, scored = [], []

    class Fitted:
        def score(self, df):
            scored.append(df)
            return df.withColumn("score", F.lit(0.5))

    monkeypatch.setattr(mo, "fit", lambda name, df, *a, **k: fits.append(df) or Fitted())
    d = type("D", (), {"matrix": spark.range(20).selectExpr("id as pid", "cast(id % 2 as int) as label", *[f"id * 1.0D as {c}" for c in mo.FEATURES])})()
    mo._fit(d, "xgb")
    assert fits[0] is scored[0] and "Project" not in fits[0]._jdf.queryExecution().optimizedPlan().toString()
