import numpy as np
import pytest
from helpers import BANDS
from pyspark.sql import functions as F

from nichefield.models import ALGORITHMS, fit, fitted_config
from nichefield.models.maxent import feature_classes
from nichefield.models.registry import changed_overrides, load_model, save_model
from nichefield.operators import ensemble as en
from nichefield.operators import evaluate as ev
from nichefield.operators import explain as ex
from nichefield.operators import select as se
from nichefield.operators import splits as sp
from nichefield.operators.common import shuffled
from nichefield.operators.quantiles import quantiles
from nichefield.plans.crossval import cross_validate
from nichefield.plans.run import Settings, run

QUICK = {"rf": {"n_estimators": 20, "max_depth": 6}, "gbm": {"n_estimators": 10, "learning_rate": 0.1},
         "xgb": {"n_estimators": 8}, "mlp": {"max_iter": 60}, "svm": {"max_iter": 10, "folds": 2, "landmarks": 24},
         "gam": {"max_iter": 20}, "lr": {"max_iter": 50}, "maxent": {"max_iter": 50}}


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    rows = [(i, *map(float, v), int(v[0] + 0.5 * v[1] > 0)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "pid bigint, a double, b double, c double, label int").cache()


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()) / (len(p) * len(n))


def brute_tss(y, s):
    return max(((s[y == 1] >= t).mean() - (s[y == 0] >= t).mean(), t) for t in np.unique(s))


def brute_boyce(y, s):
    lo, hi = s.min(), s.max()
    w = (hi - lo) * 0.1
    pe = []
    for c in np.linspace(lo + w / 2, hi - w / 2, 10):
        a, b = c - w / 2, c + w / 2
        f, g = ((s >= a) & (s <= b)).mean(), ((s[y == 1] >= a) & (s[y == 1] <= b)).mean()
        if f > 0 and g > 0:
            pe.append(g / f)
    rank = np.array([(np.array(pe) < v).sum() + ((np.array(pe) == v).sum() - 1) / 2 for v in pe])
    return np.corrcoef(np.arange(len(pe)), rank)[0, 1]


def test_metrics_match_brute_force_under_skew(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000)
    s = np.clip(y * 0.2 + rng.normal(0.4, 0.2, 3000), 0, 1).round(3)
    s[:1000] = 0.5  # a third of all records share one score
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    for parts in (1, 8):
        m = ev.evaluate(df.repartition(parts)).first()
        tss, threshold = brute_tss(y, s)
        assert abs(m.auc - brute_auc(y, s)) < 1e-12 and abs(m.tss - tss) < 1e-12 and m.threshold == threshold
        assert abs(m.boyce - brute_boyce(y, s)) < 1e-9


def test_metric_edges(spark):
    sep = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [.1, .2, .3, .7, .8, .9])), "label int, score double")
    m = ev.evaluate(sep).first()
    assert m.auc == 1 and m.tss == 1 and m.threshold == 0.7 and m.boyce is None
    keyed = sep.withColumn("k", F.col("label")).unionByName(sep.withColumn("k", F.lit(None).cast("int")))
    rows = {r.k: r for r in ev.evaluate(keyed, keys=["k"]).collect()}
    assert rows[0].auc is None and rows[1].threshold is None and rows[None].auc == 1  # one class, and a null key
    gone = sep.withColumn("score", F.lit(float("nan")))
    assert ev.evaluate(gone).first().auc is None


def test_shuffle_positions_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id").alias("pid"), (F.col("id") % 3 == 0).alias("k"))
    one = {(r.pid, r.ordinal) for r in shuffled(df.coalesce(1), "pid", 7, by=["k"]).collect()}
    many = {(r.pid, r.ordinal) for r in shuffled(df.repartition(13), "pid", 7, by=["k"]).collect()}
    assert one == many
    assert sorted(o for p, o in one if p % 3 == 0) == list(range(1667))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles(spark, limit):
    rng = np.random.default_rng(2)
    v = rng.normal(size=900).round(2)
    v[:300] = 0.25
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "k int, v double")
    rows = {r.k: r for r in quantiles(df, ["v"], [0.0, 0.025, 0.5, 0.975, 1.0], ["k"], "n", limit).collect()}
    for k in (0, 1):
        assert np.allclose(rows[k].v, np.quantile(v[k::2], [0, 0.025, 0.5, 0.975, 1])) and rows[k].n == 450


def test_vif(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame([(float(x), float(y), float(x + 0.01 * z), 3.0) for x, y, z in zip(a, b, rng.normal(size=500))],
                               "a double, b double, c double, flat double")
    kept, steps = se.stepwise_vif(df, ["a", "b", "c", "flat"])
    assert "flat" not in kept and "b" in kept and len(kept) == 2
    assert steps.where("step = 0 and feature = 'flat'").first().dropped
    assert se.stepwise_vif(df, ["a", "b"], enabled=False) == (["a", "b"], None)
    exact = df.withColumn("d", F.col("a") * 2 + F.col("b"))
    assert abs(se.vif(exact, ["a", "b", "d"]).where("feature = 'd'").first().vif - 1e6) < 1
    with pytest.raises(ValueError):
        se.vif_steps(df, ["a", "b"], 1.0)


def test_stratified_splits(spark):
    df = spark.range(100).select(F.col("id").alias("pid"), (F.col("id") < 20).cast("int").alias("label"))
    folds = sp.fold_summary(sp.split_kfold(df, "pid", "label")).collect()
    assert {(r.presences_test, r.n_test) for r in folds} == {(4, 20)}
    held = sp.split_holdout(df, "pid", "label").where("is_test")
    assert held.where("label = 1").count() == 5 and held.count() == 25
    tiny = df.limit(1).unionByName(df.where("pid = 99"))
    assert sp.split_holdout(tiny, "pid", "label").where("is_test").count() == 1
    few = sp.split_kfold(df.limit(3), "pid", k=5).groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in few) == [(0, 1), (1, 1), (2, 1)]
    with pytest.raises(ValueError):
        sp.split_kfold(df, "pid", k=1)


def test_hexagons_hold_their_nearest_centre(spark, grid):
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 40, (500, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "pid bigint, x double, y double")
    got = sp.blocks_hex(df, 4.0).toPandas()
    centres = got.drop_duplicates("block_id")[["block_id", "block_x", "block_y"]].to_numpy()
    d = np.hypot(got.x.to_numpy()[:, None] - centres[None, :, 1], got.y.to_numpy()[:, None] - centres[None, :, 2])
    own = np.hypot(got.x - got.block_x, got.y - got.block_y)
    assert (own <= d.min(1) + 1e-9).all() and own.max() <= sp.hex_radius(4.0) + 1e-9
    assert sorted(got.block_id.unique()) == list(range(len(centres)))
    ring = sp.block_corners(sp.block_folds(sp.blocks_hex(df, 4.0)), 4.0, "hexagon").first().corners
    area = 0.5 * abs(sum(ring[i].x * ring[(i + 1) % 6].y - ring[(i + 1) % 6].x * ring[i].y for i in range(6)))
    assert abs(area - 16) < 1e-9


def test_block_size_bounds(spark, cells, grid):
    r = sp.auto_block_size(cells, grid, "band_0").first()
    assert r.source == "auto_variogram" and 0.5 <= r.block_size <= 40 / 3
    none = cells.withColumn("band_0", F.lit(None).cast("double"))
    assert tuple(sp.auto_block_size(none, grid, "band_0").first()) == (2.0, "auto_fallback")


@pytest.mark.parametrize("name", ALGORITHMS)
def test_every_algorithm_scores_in_unit_interval(spark, toy, name):
    m = fit(name, toy, ["a", "b", "c"], **QUICK.get(name, {}))
    holed = toy.withColumn("a", F.when(F.col("pid") > 4, F.col("a")))
    got = m.score(holed)
    assert got.columns == [*toy.columns, "score"]
    r = got.agg(F.min("score"), F.max("score"), F.count("score"), F.count_if(F.isnan("score"))).first()
    assert 0 <= r[0] <= r[1] <= 1 and r[2] == 295 and r[3] == 0
    if name in ("lr", "rf", "gam", "gbm", "xgb", "svm", "mlp", "maxent"):
        assert ev.auc(got).first().auc > 0.85


def test_fit_errors(toy):
    with pytest.raises(ValueError, match="unknown algorithm"):
        fit("none", toy, ["a"])
    with pytest.raises(ValueError, match="no parameter"):
        fit("lr", toy, ["a"], depth=3)
    with pytest.raises(ValueError, match="both classes"):
        fit("lr", toy.where("label = 1"), ["a"])


def test_maxent_tiers_and_config():
    assert [len(feature_classes(n)) for n in (5, 12, 40, 80)] == [1, 2, 3, 4]
    assert fitted_config(["maxent"], 12)["maxent"]["feature_types"] == ["linear", "quadratic"]
    assert changed_overrides({"rf": {"n_estimators": 800, "max_depth": 30, "note": 1}}) == {"rf": {"n_estimators": 800}}


def test_maxent_table_of_knots_equals_its_features(spark, toy):
    from nichefield.models import maxent as mx
    m = fit("maxent", toy, ["a", "b"], feature_types=["linear", "quadratic", "product", "hinge", "threshold"], max_iter=30)
    st = m.state
    unit = mx._unit(m.predictors, st["lows"], st["highs"])
    direct = F.aggregate(F.zip_with(mx._expanded(unit, st["classes"], 10), F.array(*[F.lit(c) for c in st["coef"]]),
                                    lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)
    worst = toy.select(F.max(F.abs(direct - mx._linear(m)))).first()[0]
    assert worst < 1e-9


@pytest.mark.parametrize("kernel", ["linear", "poly", "sigmoid"])
def test_svm_kernels(toy, kernel):
    got = fit("svm", toy, ["a", "b"], kernel=kernel, max_iter=8, folds=2, landmarks=16).score(toy)
    assert ev.auc(got).first().auc > 0.8


def test_saved_models_score_the_same(spark, toy, tmp_path):
    for name in ("gam", "svm", "mlp"):
        m = fit(name, toy, ["a", "b"], **QUICK.get(name, {}))
        save_model(m, spark, str(tmp_path / name))
        both = load_model(spark, str(tmp_path / name)).score(m.score(toy, "u"), "v")
        assert both.agg(F.max(F.abs(F.col("u") - F.col("v")))).first()[0] < 1e-12


def test_importance_ranks_the_informative_predictor(toy):
    m = fit("lr", toy, ["a", "b", "c"], **QUICK["lr"])
    rows = {r.feature: r.importance for r in ex.importance(m, toy, "label", ["a", "b", "c"]).collect()}
    assert rows["a"] > rows["b"] > rows["c"]
    moved = ex.permute_column(toy, "pid", "a")
    assert sorted(r.a for r in moved.collect()) == sorted(r.a for r in toy.collect())


def test_failed_unit_does_not_end_the_run(toy):
    cv = cross_validate(toy, ["a", "b"], ["enfa", "rf"], lambda d, s: sp.split_kfold(d, "pid", "label", 3, s), 1,
                        params={"rf": {"n_estimators": 0}})
    assert set(cv.models) == {("enfa", 0)} and [e[:2] for e in cv.errors] == [("rf", 0)]
    assert cv.oof.count() == 300


def test_ensemble_of_opposites(spark):
    rows = [(a, 0, i // 2, i % 2, float((i % 2) if a == "u" else 1 - i % 2)) for a in ("u", "v") for i in range(4)]
    s = spark.createDataFrame(rows, "algorithm string, replicate int, row int, col int, value double")
    w = en.ensemble_weights(spark.createDataFrame([("u", -0.1), ("v", None)], "algorithm string, tss_mean double"))
    out = en.ensemble_surface(en.mean_surface(s), w).collect()
    assert all(r.value == 0.5 and r.sd == 0.5 for r in out)
    zero = spark.createDataFrame([("u", 0.0), ("v", 1.0)], "algorithm string, weight double")
    alone = en.ensemble_surface(s.where("algorithm = 'u'").drop("replicate"), zero).collect()
    assert all(r.value == 0.0 and r.sd == 0.0 for r in alone)


def test_settings_are_checked():
    Settings().check()
    for bad in ({"ratio": 0, "background": "ratio"}, {"count": 5}, {"k": 1}, {"vif_cutoff": 1.0}, {"algorithms": ()},
                {"data_mode": "presence_absence"}, {"block_meters": 0.0}, {"test_size": 1.0}, {"replicates": 0},
                {"background": "disk", "min_meters": 9.0, "max_meters": 5.0}):
        with pytest.raises(ValueError):
            Settings(**bad).check()


@pytest.mark.parametrize("mode", ["presence_only", "presence_absence"])
def test_whole_run(spark, cells, grid, mode):
    rng = np.random.default_rng(6)
    xy = rng.uniform(1, 39, (160, 2))
    occ = spark.createDataFrame([(i, float(a), float(b), int(a - b > 0)) for i, (a, b) in enumerate(xy)],
                                "rid bigint, x double, y double, presence int")
    s = Settings(data_mode=mode, background="ratio", ratio=2.0, k=3, replicates=1, ensemble="weighted_auc",
                 algorithms=("lr", "rf"), params=QUICK, split="spatial_block" if mode == "presence_only" else "random",
                 block_shape="hexagon")
    future = cells.withColumn("band_0", F.col("band_0") + 5)
    out = run(occ, cells, grid, s, projection_cells=future)
    r = out.surface.agg(F.min("value"), F.max("value"), F.count("value"), F.min("sd")).first()
    assert 0 <= r[0] <= r[1] <= 1 and r[2] == 1600 and r[3] >= 0
    assert {x.algorithm for x in out.metrics.collect()} == {"lr", "rf", "Ensemble"}
    assert out.mess.where("mess < 0").count() > 1000  # a warmer future is novel
    notes = {n.heading: n for n in out.notes.collect()}
    assert notes["Extrapolation in the projection"].tone == "caution"
    assert ("What the scores mean here" in notes) == (mode == "presence_only")
    if mode == "presence_absence":
        auc = {x.algorithm: x.auc for x in out.metrics.collect()}
        assert auc["lr"] > 0.85 and auc["rf"] > 0.85
    assert set(BANDS) >= set(out.predictors)


@pytest.mark.parametrize("name", ["lr", "gam", "mlp", "maxent"])
def test_registered_fits_at_defaults(monkeypatch, name):
    """Both registered forms fit with no reduced sizes."""
    from types import SimpleNamespace

    from nichefield.catalog import modelling

    asked = []

    def recorded(*args, **params):
        asked.append(params)
        raise StopIteration

    monkeypatch.setattr(modelling, "fit", recorded)
    for run_fit in (modelling._fit, modelling._checked):
        with pytest.raises(StopIteration):
            run_fit(SimpleNamespace(matrix=None), name)
    assert asked == [{}, {}]


def test_records_of_a_task_are_bounded(spark, monkeypatch):
    """More records than the shuffle's width can share make more tasks, and the records stay the same."""
    from nichefield.catalog import tables
    folder = "/root/testdata/sf0.001"
    whole = tables.Data(spark, folder).matrix.toPandas().sort_values("pid")
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    d = tables.Data(spark, folder)
    sizes = [r["n"] for r in d.matrix.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 2 * 300
    assert d.matrix.toPandas().sort_values("pid").reset_index(drop=True).equals(whole.reset_index(drop=True))
