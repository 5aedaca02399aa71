"""Fits of many keys in one job against fits of one key at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichefield.models import fit, fit_by, grouped


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n, slope in (("a", 900, 2.0), ("b", 150, -1.5), (None, 300, 0.4)):
        x = rng.normal(size=(n, 2)) * [1.0, 30.0] + [0.0, 500.0]
        y = rng.uniform(size=n) < 1 / (1 + np.exp(-(slope * x[:, 0] + (x[:, 1] - 500) ** 2 / 900 - 0.5)))
        rows += [(key, float(u), float(v), int(k), i) for i, ((u, v), k) in enumerate(zip(x, y))]
    rows += [("one", 1.0, 2.0, 1, 0), ("one", 2.0, 2.0, 1, 1), ("a", None, 1.0, 1, -1), ("a", float("nan"), 1.0, 0, -2)]
    return spark.createDataFrame(rows, "k string, u double, v double, label int, i int").repartition(5).cache()


@pytest.mark.parametrize("name,tolerance", [("lr", 1e-4), ("gam", 1e-3), ("enfa", 1e-9)])
def test_each_key_as_if_alone(spark, toy, name, tolerance):
    m = fit_by(name, toy, ["u", "v"], "k")
    got = {(r.k, r.i): r.score for r in m.score(toy).collect()}
    assert len(got) == toy.count() and got["a", -1] is None and got["a", -2] is None and got["one", 0] is None
    assert [r.k for r in m.failed.collect()] == ["one"]
    for key in ("a", "b", None):
        own = toy.where(F.col("k").eqNullSafe(F.lit(key)))
        for r in fit(name, own, ["u", "v"]).score(own).collect():
            assert (r.score is None and got[key, r.i] is None) or math.isclose(r.score, got[key, r.i], abs_tol=tolerance)


def test_hot_keys_are_parted_and_many_keys_sliced(spark, toy, monkeypatch):
    """The same coefficients when a key's rows lie in several parts, and when keys are done in slices."""
    before = {r.k: r.beta for r in fit_by("lr", toy, ["u", "v"], "k").state.collect()}
    monkeypatch.setattr(grouped, "ROWS_PER_PART", 50)
    monkeypatch.setattr(grouped, "KEYS_AT_ONCE", 1)
    m = fit_by("lr", toy, ["u", "v"], "k")
    for r in m.state.collect():
        assert np.allclose(r.beta, before[r.k], atol=1e-7)
    assert m.score(toy).where("score is not null").count() == 1350


def test_separated_classes_and_constants(spark):
    """Separated classes stay finite under the penalty; a constant predictor does no harm."""
    rows = [("s", float(i), 7.0, int(i > 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, u double, v double, label int")
    for name in ("lr", "gam", "enfa"):
        got = fit_by(name, df, ["u", "v"], ["k"]).score(df).agg(F.min("score"), F.max("score"), F.count("score")).first()
        assert got[2] == 100 and 0 <= got[0] <= got[1] <= 1


def test_two_keys_and_no_rows(spark, toy):
    df = toy.withColumn("half", F.col("i") % 2)
    m = fit_by("lr", df, ["u"], ["k", "half"])
    assert m.state.count() == 6 and m.score(df).where("score is not null").count() == 1350
    empty = fit_by("lr", df.limit(0), ["u"], ["k"])
    assert empty.state.count() == 0 and empty.score(df).where("score is not null").count() == 0
    with pytest.raises(ValueError, match="no grouped fit"):
        fit_by("rf", df, ["u"], ["k"])
    with pytest.raises(ValueError, match="no parameter"):
        fit_by("lr", df, ["u"], ["k"], depth=2)


def test_own_algorithm_everywhere(spark, toy):
    """A registered algorithm is cross-validated, scored on cells and saved like the built-in ones; the built-in ones are safe."""
    from nichefield.catalog.modelling import _centres, fit_centres
    from nichefield.models import algorithms, defaults, register, unregister
    from nichefield.models.base import in_batches
    from nichefield.operators.surfaces import predict_wide
    from nichefield.operators import splits
    from nichefield.plans.crossval import cross_validate
    register("centres", fit_centres, in_batches(_centres), {"power": 2})
    try:
        assert "centres" in algorithms() and defaults("centres") == {"power": 2}
        df = toy.where("k = 'a'").select(F.col("i").alias("pid"), "label", "u", "v")
        cv = cross_validate(df, ["u", "v"], ["centres", "enfa"], lambda rows, seed: splits.split_kfold(rows, "pid", "label", 3, seed), replicates=1, params={"centres": {"power": 1}})
        assert not cv.errors and cv.oof.where("algorithm = 'centres' and score between 0 and 1").count() == 900
        cells = toy.select(F.col("i").alias("row"), F.lit(0).alias("col"), "u", "v")
        wide = predict_wide(cv.models, cells)
        assert wide.where("centres is null").count() == 2 and {"centres", "enfa"} <= set(wide.columns)
        with pytest.raises(ValueError, match="no parameter"):
            fit("centres", df, ["u"], depth=1)
        with pytest.raises(ValueError, match="built in"):
            register("lr", fit_centres, in_batches(_centres))
    finally:
        unregister("centres")
    with pytest.raises(ValueError, match="unknown algorithm"):
        fit("centres", toy, ["u"])


def test_perceptron_gradient_against_differences():
    """The backward pass agrees with finite differences, the curvature with those of the gradient on the linear side."""
    from nichefield.models import mlp
    rng = np.random.default_rng(1)
    z, y, theta = rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float), rng.normal(size=3 * 4 + 9)
    loss, gradient, curvature = mlp.passes(z, y, theta, 4)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        assert abs((mlp.passes(z, y, theta + step, 4)[0] - mlp.passes(z, y, theta - step, 4)[0]) / 2e-6 - gradient[i]) < 1e-4
    assert np.allclose(curvature, curvature.T) and np.linalg.eigvalsh(curvature).min() > -1e-9


def test_perceptron_settles_and_decays(spark, toy):
    """More decay, smaller weights; the fit separates what a ring needs units for."""
    rows = toy.where("k = 'a'")
    small, large = (fit("mlp", rows, ["u", "v"], alpha=a, max_iter=80) for a in (0.01, 100.0))
    assert np.square(large.state["theta"][:16]).sum() < np.square(small.state["theta"][:16]).sum()
    from nichefield.operators.evaluate import auc
    assert auc(small.score(rows).where("score is not null"), "label", "score").first().auc > 0.85


def test_first_rounds_on_a_share(spark, toy, monkeypatch):
    """A key with many rows starts on a share of them and ends at the same coefficients."""
    before = {r.k: r.beta for r in fit_by("gam", toy, ["u", "v"], "k").state.collect()}
    seen, sums = [], grouped._sums
    monkeypatch.setattr(grouped, "START_ROWS", 100)
    monkeypatch.setattr(grouped, "START_PRESENCES", 10)
    monkeypatch.setattr(grouped, "_sums", lambda design, state, *rest: seen.append(set(state.value)) or sums(design, state, *rest))
    for r in fit_by("gam", toy, ["u", "v"], "k").state.collect():
        assert np.allclose(r.beta, before[r.k], atol=1e-6)
    assert seen[0] == {("a",)} and {("a",), ("b",), (None,)} in seen  # "one" cannot be fitted, the others are few


def test_spline_scores_are_compiled(spark, toy):
    """Scores of four splines fit a compiled method instead of falling back to evaluation row by row."""
    df = toy.withColumns({"w": F.col("u") * F.col("u"), "z": F.col("v") - F.col("u")})
    m = fit_by("gam", df, ["u", "v", "w", "z"], "k")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert 0 < m.score(df).agg(F.avg("score")).first()[0] < 1
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
