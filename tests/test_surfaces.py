import numpy as np
import pytest
from pyspark.sql import functions as F

from nichefield import Grid, Layer
from nichefield.operators import surfaces as su
from nichefield.operators import transfer as tr
from nichefield.operators.notes import run_notes
from nichefield.operators.regrid import regrid

P = ["u", "v"]


@pytest.fixture(scope="module")
def training():
    rng = np.random.default_rng(11)
    t = rng.normal(size=(330, 2)).round(2)
    t[:110] = t[0]  # a third of the training records are copies
    return t


@pytest.fixture(scope="module")
def points():
    x = np.random.default_rng(12).normal(scale=1.6, size=(400, 2)).round(2)
    x[5, 1] = np.nan
    return x


def frame(spark, values, ident=False):
    rows = [(i // 20, i % 20, *[None if np.isnan(a) else float(a) for a in v]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "row int, col int, u double, v double")


def brute_mess(x, t):
    out = []
    for p in x:
        sims = []
        for j in range(2):
            lo, hi, f = t[:, j].min(), t[:, j].max(), (t[:, j] <= p[j]).sum()
            n = len(t)
            sims.append((p[j] - lo) / (hi - lo) * 100 if p[j] < lo else (hi - p[j]) / (hi - lo) * 100 if p[j] > hi
                        else min(f, n - f) / n * 200)
        out.append(None if np.isnan(p).any() else min(sims))
    return out


def brute_mop(x, t):
    mu, sd = t.mean(0), t.std(0)
    a, b = (x - mu) / sd, (t - mu) / sd
    d = np.sort(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), axis=1)[:, :33].mean(1)
    return [None if np.isnan(p).any() else v for p, v in zip(x, d)]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_mess_and_mop_match_brute_force(spark, training, points, limit):
    cells, known = frame(spark, points), frame(spark, training)
    mess = {(r.row, r.col): r.mess for r in tr.mess(cells, known, P, broadcast_values=limit).collect()}
    mop = {(r.row, r.col): r.mop for r in tr.mop(cells, known, P, broadcast_values=limit).collect()}
    assert len(mess) == len(mop) == 400
    for i, (a, b) in enumerate(zip(brute_mess(points, training), brute_mop(points, training))):
        got = mess[i // 20, i % 20], mop[i // 20, i % 20]
        assert (a is None and got == (None, None)) or (abs(a - got[0]) < 1e-9 and abs(b - got[1]) < 1e-9)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_mess_keeps_every_cell_of_every_key(spark, limit):
    """Null keys have their own records; a key without records gives NULL; a key without cells gives no row."""
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 1, 2.0), (None, 0, 2, 3.0), ("a", 0, 3, None)], "k string, row int, col int, u double")
    known = spark.createDataFrame([("a", 0.0), ("a", 4.0), (None, 2.0), (None, 2.5), ("z", 9.0)], "k string, u double")
    got = {r.col: r.mess for r in tr.mess(cells, known, ["u"], keys=["k"], broadcast_values=limit).collect()}
    assert got == {0: 100.0, 1: None, 2: -100.0, 3: None}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_keep_every_group(spark, limit):
    from nichefield.operators.quantiles import quantiles
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("n", None), (None, 5.0), (None, None)], "k string, v double")
    for count in ("n", None):
        got = {r.k: r.v for r in quantiles(rows, ["v"], [0.5], ["k"], count, in_task_rows=limit).collect()}
        assert got == {"a": [2.0], "n": None, None: [5.0]}


@pytest.mark.parametrize("row_box,point_box", [(16, 8), (60, 1000), (10**6, 20)])
def test_mop_in_many_boxes(spark, training, points, row_box, point_box):
    mu, sd = training.mean(0), training.std(0)
    cells = frame(spark, (points - mu) / sd)
    known = frame(spark, (training - mu) / sd).select(*P).groupBy(*P).agg(F.count(F.lit(1)).alias("c"))
    got = {(r.row, r.col): r.mop for r in tr._mop_boxed(cells, known, P, 10.0, row_box=row_box, point_box=point_box).collect()}
    for i, b in enumerate(brute_mop(points, training)):
        v = got[i // 20, i % 20]
        assert (b is None and v is None) or abs(b - v) < 1e-9


def test_boxes_leave_most_distances_out():
    """Means are exact, repeated rows count, and a small share of all pairs is computed."""
    from nichefield.operators.nearest import BoxIndex
    rng = np.random.default_rng(5)
    rows, x = rng.uniform(size=(6000, 3)), rng.uniform(size=(3000, 3)) * 1.1
    rows[:2000] = rows[0]
    distinct, counts = np.unique(rows, axis=0, return_counts=True)
    index = BoxIndex(distinct, counts)
    for k in (1, 60, 600, 5999, 6000):
        mean, done = index.mean(x, k)
        d = np.sort(np.sqrt(((x[:, None] - rows[None]) ** 2).sum(2)), axis=1)[:, :k].mean(axis=1)
        assert np.allclose(mean, d, atol=1e-12)
        if k == 60:
            assert done.sum() < 0.1 * len(x) * len(rows)


def test_mop_computes_little_for_neighbouring_cells(spark):
    """Cells reach tasks as neighbours, so hardly more than the nearest tenth of the distances is computed, in both forms."""
    cells = spark.range(24_000).select(F.floor(F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"),
                                       *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_000)) / 10_000).alias(f"p{i}") for i in range(3)])
    predictors, means = ["p0", "p1", "p2"], []
    for limit in (0, 10**6):
        got = tr.mop(cells, cells.where("pmod(xxhash64(row, col), 4) = 0"), predictors, keys=[], broadcast_values=limit, distances=True)
        means.append({(r.row, r.col): r.mop for r in got.collect()})
        assert got.agg(F.sum("distances")).first()[0] < 0.19 * 24_000 * 6_000
    assert max(abs(means[0][c] - means[1][c]) for c in means[0]) < 1e-12


def test_close_distances_keep_their_digits():
    from nichefield.operators.nearest import distances
    x = np.random.default_rng(2).uniform(size=(20, 3)) + 50
    y = np.concatenate([x, x + 1e-7, x - 3])
    assert np.allclose(distances(x, y.T), np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)), rtol=1e-12, atol=0)


def test_mop_keeps_every_cell_of_every_key(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 1, 2.0), (None, 0, 2, 3.0), ("a", 0, 3, None), ("a", 0, 4, 1.0)], "k string, row int, col int, u double")
    known = spark.createDataFrame([("a", 0.0), ("a", 4.0), ("a", 0.0), (None, 2.0), (None, 4.0), ("z", 9.0)], "k string, u double")
    for limit in (0, 10**6):
        got = {r.col: r.mop for r in tr.mop(cells, known, ["u"], keys=["k"], percentile=60.0, broadcast_values=limit).collect()}
        sd = np.std([0, 4, 0])
        assert got[1] is None and got[3] is None and abs(got[0] - 1 / sd) < 1e-12 and got[0] == got[4] and abs(got[2] - 1.0) < 1e-12
        assert tr.mop(cells.limit(0), known, ["u"], keys=["k"], broadcast_values=limit).count() == 0
        assert tr.mop(cells, known.limit(0), ["u"], keys=["k"], broadcast_values=limit).where("mop is null").count() == 5


def test_predictors_go_by_name(spark, training):
    cells = frame(spark, training[:200]).withColumn("other", F.lit(99.0))
    a = tr.mess(cells, frame(spark, training), ["v"]).agg(F.sum("mess")).first()[0]
    b = tr.mess(cells.select("v", "other", "col", "row", "u"), frame(spark, training), ["v"]).agg(F.sum("mess")).first()[0]
    assert a == b


def test_nearest_count_rounds_half_to_even():
    assert [tr.nearest_count(n, 10.0) for n in (1, 25, 35, 100)] == [1, 2, 4, 10]


def values(spark, grid, fn, name="L"):
    rows = [(name, r, c, fn(r, c)) for r in range(grid.height) for c in range(grid.width)]
    return spark.createDataFrame(rows, "layer string, row int, col int, value double")


def at(df):
    return {(r.row, r.col): r.value for r in df.collect()}


def test_regrid_keeps_categories_and_planes(spark):
    src = Grid(0, 20, 1, 1, 20, 20)
    layer = Layer.on_grid("L", src)
    target = Grid(2.5, 18.0, 0.5, 0.5, 20, 20)
    classes = at(regrid(values(spark, src, lambda r, c: float((r * c) % 3)), [layer], target, "nearest"))
    assert set(classes.values()) <= {0.0, 1.0, 2.0} and len(classes) == 400
    for method in ("bilinear", "cubic"):  # both reproduce a plane exactly away from the edge
        plane = at(regrid(values(spark, src, lambda r, c: 3.0 * c - 2.0 * r), [layer], target, method))
        for (r, c), v in plane.items():
            x, y = 2.5 + (c + 0.5) * 0.5, 18.0 - (r + 0.5) * 0.5
            assert abs(v - (3.0 * (x - 0.5) - 2.0 * (20 - y - 0.5))) < 1e-9


def test_regrid_pools_and_leaves_uncovered_null(spark):
    src = Grid(0, 4, 1, 1, 4, 4)
    df = values(spark, src, lambda r, c: float(r * 4 + c))
    target = Grid(0, 4, 2, 2, 3, 2)
    low, mid, high = (at(regrid(df, [Layer.on_grid("L", src)], target, m)) for m in ("min", "average", "max"))
    assert (low[0, 0], mid[0, 0], high[0, 0]) == (0.0, 2.5, 5.0) and mid[0, 2] is None
    assert at(regrid(df, [Layer.on_grid("L", src)], target, "median"))[1, 1] == 12.5
    with pytest.raises(ValueError):
        regrid(df, [Layer.on_grid("L", src)], target, "lanczos")


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "average"])
def test_regrid_makes_nothing_up_outside(spark, method):
    src = Grid(0, 4, 1, 1, 4, 4)
    got = at(regrid(values(spark, src, lambda r, c: 7.0), [Layer.on_grid("L", src)], Grid(-2, 4, 0.5, 0.5, 16, 8), method))
    assert all((v is None) == (c < 4 or c >= 12) for (r, c), v in got.items())


def test_regrid_finer_between_coordinate_systems_has_no_holes(spark):
    src = Grid(14.0, 46.0, 0.1, 0.1, 20, 20, "EPSG:4326")
    target = Grid(480000, 5000000, 1000, 1000, 20, 20, "EPSG:32633")
    for method in ("average", "max"):
        got = at(regrid(values(spark, src, lambda r, c: float(c)), [Layer.on_grid("L", src)], target, method))
        assert None not in got.values()


def test_regrid_between_coordinate_systems(spark):
    src = Grid(14.0, 46.0, 0.1, 0.1, 20, 20, "EPSG:4326")
    df = values(spark, src, lambda r, c: float(c))
    target = Grid(450000, 5000000, 10000, 10000, 8, 8, "EPSG:32633")
    for method in ("nearest", "bilinear", "average", "mode"):
        got = at(regrid(df, [Layer.on_grid("L", src)], target, method))
        assert len(got) == 64 and got[4, 1] is not None and got[4, 1] < got[4, 6]


def test_wide_and_long_ensembles_agree(spark):
    from nichefield.operators import ensemble as en
    rows = [(a, r, c, None if (r + c + k) % 4 == 0 else (r * 3 + c * k) % 7 / 7) for k, a in enumerate("xyz") for r in range(6) for c in range(6)]
    long = spark.createDataFrame(rows, "algorithm string, row int, col int, value double")
    weights = {"x": 0.5, "y": 0.5, "z": 0.0}
    table = spark.createDataFrame(list(weights.items()), "algorithm string, weight double")
    wide = long.groupBy("row", "col").pivot("algorithm", list("xyz")).agg(F.first("value"))
    a = {(r.row, r.col): (r.value, r.sd) for r in en.ensemble_surface(long, table).collect()}
    for r in su.ensemble_wide(wide, weights).collect():
        for u, v in zip((r.value, r.sd), a[r.row, r.col]):
            assert (u is None and v is None) or abs(u - v) < 1e-12


def test_scoring_a_grid_never_shuffles(spark, cells):
    from nichefield.models.base import Model
    m = Model("enfa", ["band_0", "band_1"], {}, {"mean": [0, 0], "sd": [1, 1], "centre": [0, 0], "precision": [[1, 0], [0, 1]], "scale": 1.0})
    wide = su.ensemble_wide(su.predict_wide({("enfa", 0): m, ("enfa", 1): m}, cells), {"enfa": 1.0})
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def notes_for(spark, **facts):
    base = {"disagreement_share": 0.05, "suitable_share": 0.3, "extrapolated_share": None, "train_auc": 0.8, "cv_auc": 0.79,
            "split_method": "kfold", "n_presence": 60, "has_maxent": False, "n_dropped": 0, "presence_only": False, "removed": 0.0}
    base.update(facts)
    schema = ("run string, disagreement_share double, suitable_share double, extrapolated_share double, train_auc double, cv_auc double, "
              "split_method string, n_presence bigint, has_maxent boolean, n_dropped int, presence_only boolean, removed double")
    summary = spark.createDataFrame([("r", "lr", 0.8, 0.5, 0.3, 0.01, 0.02, None), ("r", "rf", 0.9, 0.72, 0.9, 0.01, 0.12, 0.0)],
                                    "run string, algorithm string, auc_mean double, tss_mean double, boyce_mean double, auc_sd double, tss_sd double, boyce_sd double")
    rows = run_notes(summary, spark.createDataFrame([("r", *base.values())], schema), ["run"]).collect()
    return {r.heading: (r.tone, r.text) for r in rows}


def test_notes_follow_the_rules(spark):
    n = notes_for(spark)
    assert n["Overall performance"][0] == "good" and "rf" in n["Overall performance"][1]  # best TSS without an ensemble
    assert "which algorithm" in n["Overall performance"][1] and "A mixed signal" not in n
    assert n["Run-to-run stability"][0] == "caution" and n["Sample size"][0] == "ok"
    assert n["Generalization"][0] == "good" and "Extrapolation in the projection" not in n
    n = notes_for(spark, disagreement_share=0.3, extrapolated_share=0.25, train_auc=0.95, cv_auc=0.7, n_presence=20,
                  n_dropped=2, presence_only=True, removed=0.4, split_method="spatial_block")
    for heading in ("Agreement between algorithms", "Extrapolation in the projection", "Overfitting", "Sample size",
                    "Records removed in cleaning"):
        assert n[heading][0] == "caution"
    assert n["How performance was tested"][0] == "good" and "Dropped predictors" in n


def test_mop_holds_a_bounded_part_of_a_large_shell(monkeypatch):
    """Points far apart make all rows a shell: their distances must not be held for all points at once."""
    from nichefield.operators import nearest as ne
    rng = np.random.default_rng(3)
    rows, x, sizes, made = rng.normal(size=(5000, 3)), rng.normal(size=(16, 3)) * 9, [], ne._all_distances
    monkeypatch.setattr(ne, "SHELL_PAIRS", 6_000, raising=False)
    monkeypatch.setattr(ne, "_all_distances", lambda *a: sizes.append((d := made(*a)).size) or d)
    got, _ = ne.BoxIndex(rows, np.ones(5000)).mean(x, 500)
    want = np.sort(np.sqrt(((x[:, None] - rows) ** 2).sum(axis=2)), axis=1)[:, :500].mean(axis=1)
    assert np.abs(got - want).max() < 1e-9 and max(sizes) <= 6_000
