import numpy as np
import pytest
from helpers import BANDS
from pyspark.sql import functions as F

from nichefield import Grid, Layer
from nichefield.functions import coordinates as co
from nichefield.operators import background as bg
from nichefield.operators import cells as ce
from nichefield.operators import clean as cl
from nichefield.operators import layers as la
from nichefield.operators.nearby import in_distance_band
from nichefield.sources import read_geojson_points, read_points, write_surface

DIRTY = [(0, 5.0, 5.0, 1), (1, 5.0, 5.0, 1), (2, 0.0, 0.0, 1), (3, None, 5.0, 1), (4, 100.0, 100.0, 1),
         (5, 20.0, 20.0, 1), (6, 5.0, float("nan"), 1), (7, 40.0, 20.0, 1)]
SCHEMA = "rid bigint, x double, y double, presence int"


def test_every_cleaning_rule_fires(spark, cells, grid):
    occ = spark.createDataFrame(DIRTY, SCHEMA)
    kept = cl.clean_points(occ, cells, grid).collect()
    assert {(r.rid, r.x, r.y) for r in kept} == {(0, 5.0, 5.0), (5, 20.0, 20.0)}
    report = {r.rule: r.dropped for r in cl.clean_report(occ, cells, grid).collect()}
    # The point on the right edge is inside the extent but on no cell.
    assert report == {"nan_coords": 2, "duplicate": 1, "zero_zero": 1, "out_of_extent": 1, "nodata_cell": 1}


def test_infinite_coordinate_is_out_of_extent(spark, cells, grid):
    occ = spark.createDataFrame([(0, float("inf"), 5.0, 1), (1, 3.0, 3.0, 1)], SCHEMA)
    assert {r.rule for r in cl.clean_report(occ, cells, grid).collect()} == {"out_of_extent"}


def test_duplicate_keeps_first_by_input_order(spark, cells, grid):
    occ = spark.createDataFrame([(9, 5.0, 5.0, 0), (4, 5.0, 5.0, 1)], SCHEMA)
    kept = cl.clean_points(occ, cells, grid).collect()
    assert [(r.rid, r.presence) for r in kept] == [(4, 1)]


def test_thinning_keeps_one_per_pixel_and_class(spark, grid):
    occ = spark.createDataFrame([(0, 5.1, 5.1, 1), (1, 5.2, 5.2, 1), (2, 5.3, 5.3, 1), (3, 9.5, 9.5, 1), (4, 5.3, 5.3, 0),
                                 (5, -3.0, 5.0, 1)], SCHEMA)
    assert {r.rid for r in cl.thin_points(occ, grid).collect()} == {0, 3, 4, 5}
    assert cl.thin_report(occ, grid).first().n_removed == 2


def test_skewed_cell_is_looked_up_once_per_point(spark, cells, grid):
    occ = spark.range(3000).select(F.col("id").alias("rid"), F.when(F.col("id") < 1000, 7.5).otherwise(F.col("id") % 40 + 0.5).alias("x"),
                                   F.lit(7.5).alias("y"))
    for limit in (1_000_000, 0):
        seen = ce.extract_at(occ, cells, grid, BANDS, broadcast_rows=limit)
        assert seen.count() == 3000 and seen.where("band_0 is null").count() == 0


def _nearest(c, p):
    return np.sqrt(((c[:, None, :] - p[None, :, :]) ** 2).sum(2).min(1))


@pytest.mark.parametrize("low,high", [(0.0, 0.5), (0.4, 0.0), (0.3, 1.2)])
def test_distance_band_matches_brute_force(spark, low, high):
    rng = np.random.default_rng(3)
    # A third of all presences in one tight clump, plus exact copies.
    p = np.vstack([rng.uniform(0, 20, (200, 2)), rng.normal(10, 0.01, (100, 2)), np.repeat([[3.0, 3.0]], 50, 0)])
    c = np.vstack([rng.uniform(0, 20, (600, 2)), rng.normal(10, 0.6, (200, 2)), [[3.0 + high, 3.0], [3.0 + low, 3.0]]])
    pres = spark.createDataFrame([(float(a), float(b)) for a, b in p], "x double, y double")
    cand = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(c)], "i bigint, x double, y double")
    got = {r.i for r in in_distance_band(cand, pres, "i", low, high).collect()}
    d2 = ((c[:, None, :] - p[None, :, :]) ** 2).sum(2).min(1)
    want = {i for i, v in enumerate(d2) if v >= low * low and (high == 0 or v <= high * high)}
    assert got == want


def test_ring_uses_the_nearest_presence(spark, cells, grid):
    pres = spark.createDataFrame([(0, 10.0, 20.0, 1), (1, 30.0, 20.0, 1)], SCHEMA)
    got = bg.background_disk(pres, cells, grid, 300, BANDS, 3.0, 8.0).toPandas()
    d = _nearest(got[["x", "y"]].to_numpy(), np.array([[10.0, 20.0], [30.0, 20.0]]))
    assert len(got) == 300 and d.min() >= 3.0 and d.max() <= 8.0


def test_sampling_is_the_same_on_any_partitioning(spark, cells, grid):
    one = bg.background_random(cells.coalesce(1), grid, 500, BANDS).collect()
    many = bg.background_random(cells.repartition(7), grid, 500, BANDS).collect()
    assert sorted(one) == sorted(many) and len(one) == 500


def test_random_background_lands_on_valid_cells_only(spark, cells, grid):
    holed = cells.withColumn("band_0", F.when(F.col("col") >= 10, F.col("band_0")))
    got = bg.background_random(holed, grid, 400, BANDS).toPandas()
    assert len(got) == 400 and got.x.min() >= 10


def test_background_may_fall_short_without_error(spark, cells, grid):
    none = cells.withColumn("band_0", F.lit(None).cast("double"))
    assert bg.background_random(none, grid, 10, BANDS).count() == 0


def test_envelope_background_is_outside(spark, cells, grid):
    pres = spark.createDataFrame([(i, 18 + i % 5, 18.0 + i // 5, 1) for i in range(25)], "rid bigint, x int, y double, presence int") \
        .withColumn("x", F.col("x").cast("double"))
    seen = ce.extract_at(pres, cells, grid, BANDS)
    env = bg.presence_envelope(seen, BANDS, 0.0).first()
    got = ce.extract_at(bg.background_sre(pres, cells, grid, 200, BANDS, 0.0), cells, grid, BANDS).collect()
    assert len(got) == 200
    assert all(any(r[b] < env[f"{b}_low"] or r[b] > env[f"{b}_high"] for b in BANDS) for r in got)


def test_background_errors(spark, cells, grid):
    occ = spark.createDataFrame(DIRTY, SCHEMA)
    for bad in ((-1.0, 5.0), (5.0, 5.0)):
        with pytest.raises(ValueError):
            bg.background_disk(occ, cells, grid, 10, BANDS, *bad)
    with pytest.raises(ValueError):
        bg.presence_envelope(occ, BANDS, 0.5)
    with pytest.raises(ValueError):
        bg.background_count(occ, "ratio", ratio=0.0)
    with pytest.raises(ValueError, match="no location"):
        bg.background_disk(occ, cells, grid, 10, BANDS, 500.0, 0.0)


def test_ratio_rounds_half_up(spark):
    occ = spark.range(35).select(F.lit(1).alias("presence"))
    assert bg.background_count(occ, "ratio", ratio=1.5).first().n == 53


def test_label_modes(spark, cells, grid):
    occ = spark.createDataFrame([(0, 5.5, 5.5, 0), (1, 6.5, 6.5, 0)], SCHEMA)
    assert bg.label_points(occ, None, cells, grid, BANDS).where("label = 1").count() == 2  # none flagged: all are presences
    flagged = occ.withColumn("presence", (F.col("rid") == 1).cast("int"))
    assert bg.label_points(flagged, None, cells, grid, BANDS).count() == 1
    assert bg.label_points(flagged, None, cells, grid, BANDS, "presence_absence").count() == 2


def test_utm_against_known_values(spark):
    df = spark.createDataFrame([(15.0, 0.0), (15.0, 45.0), (12.0, 52.0)], "x double, y double")
    rows = co.reproject(df, "EPSG:4326", "EPSG:32633").collect()
    assert abs(rows[0].x - 500000) < 1e-6 and abs(rows[0].y) < 1e-6
    assert abs(rows[1].y - 4982950.400) < 1e-2
    back = co.reproject(co.reproject(df, "EPSG:4326", "EPSG:32733"), "EPSG:32733", "EPSG:4326").collect()
    assert all(abs(a.x - b.x) < 1e-8 and abs(a.y - b.y) < 1e-8 for a, b in zip(back, df.collect()))
    with pytest.raises(ValueError):
        co.reproject(df, "EPSG:4326", "EPSG:9999")


def test_metres_to_degrees():
    assert abs(co.meters_per_degree_value(0.0) - 110574.3) < 1
    assert abs(co.meters_per_degree_value(90.0) - 111693.9) < 1
    with pytest.raises(ValueError):
        co.is_geographic("")


def test_layer_differences_and_target(spark):
    base = Layer("bio1", "EPSG:32633", "float32", 40, 40, 1, 0, 0, 0, -1, 40, -9999.0)
    coarse = Layer("bio2", "EPSG:32633", "float32", 20, 20, 2, 0, 0.5, 0, -2, 40)
    shifted = Layer("bio3", "EPSG:32633", "int16", 40, 40, 1, 0, 3, 0, -1, 40)
    assert la.differences(base, coarse) == {"crs": False, "size": True, "resolution": True, "origin": True,
                                            "rotation": False, "extent": True, "fractional_offset": True}
    assert not la.differences(base, shifted)["fractional_offset"] and la.differences(base, shifted)["extent"]
    with pytest.raises(ValueError, match="bio2: size, resolution, origin"):
        la.check_stackable([base, coarse])
    with pytest.raises(ValueError, match="unique"):
        la.check_stackable([base, base])
    target = la.build_target(spark, [base, coarse], "EPSG:32633")
    assert (target.res_x, target.minx, target.width) == (2.0, 0.5, 20)
    assert la.build_target(spark, [base, coarse], "EPSG:32633", "union", "finest").width == 41
    far = Layer("far", "EPSG:32633", "float32", 5, 5, 1, 0, 900, 0, -1, 40)
    with pytest.raises(ValueError, match="empty"):
        la.build_target(spark, [base, far], "EPSG:32633")
    geo = la.build_target(spark, [Layer("g", "EPSG:4326", "float32", 10, 10, 0.1, 0, 14, 0, -0.1, 46)], "EPSG:32633")
    assert 70_000 < geo.maxx - geo.minx < 90_000
    assert la.layers_frame(spark, [base, coarse]).where("differs_resolution").count() == 1


def test_storage_types(spark):
    bare = Layer("n", "", "float32", 10, 10, 1.0, 0, 500000, 0, -1.0, 5000000)
    with pytest.raises(ValueError, match="assume"):
        la.build_target(spark, [bare], "EPSG:32633")
    assert la.build_target(spark, [bare], "EPSG:32633", assumed_crs="EPSG:32633").width == 10
    assert la.default_nodata("uint8") == 255 and la.default_nodata("int16") == -9999
    assert not la.nodata_fits(-9999, "uint8") and not la.nodata_fits(0.5, "int32") and la.nodata_fits(float("nan"), "float32")


def test_own_nodata_only(spark):
    layers = [Layer("A", "", "float32", 2, 1, 1, 0, 0, 0, -1, 1, -9999.0), Layer("B", "", "float32", 2, 1, 1, 0, 0, 0, -1, 1)]
    values = spark.createDataFrame([("A", 0, 0, -9999.0), ("A", 0, 1, 1.0), ("B", 0, 0, -9999.0), ("B", 0, 1, float("nan"))],
                                   "layer string, row int, col int, value double")
    rows = {r.col: r for r in ce.build_cells(values, layers).collect()}
    assert rows[0].A is None and rows[0].B == -9999.0 and rows[1].A == 1.0 and rows[1].B is None


def test_read_points(spark, tmp_path):
    tsv = tmp_path / "p.tsv"
    tsv.write_text("lon\tlat\tn\n1.5\t2.5\t7\n3.0\t\t-2\n")
    rows = read_points(spark, str(tsv), "lon", "lat", "n").orderBy("rid").collect()
    assert [(r.x, r.y, r.presence) for r in rows] == [(1.5, 2.5, 1), (3.0, None, 0)]
    with pytest.raises(ValueError, match="available"):
        read_points(spark, str(tsv), "x", "y")
    with pytest.raises(ValueError, match="not found"):
        read_points(spark, str(tsv), "lon", "lat", "missing")
    with pytest.raises(ValueError, match="extension"):
        read_points(spark, str(tmp_path / "p.xls"))


def test_read_geojson(spark, tmp_path):
    path = tmp_path / "p.geojson"
    path.write_text("""{"type": "FeatureCollection",
 "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 5}},
  {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[3, 4], [5, 6]]}, "properties": {"n": null}},
  {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[3, 4], [5, 6]]}, "properties": {}},
  {"type": "Feature", "geometry": null, "properties": {}}]}""")
    rows = read_geojson_points(spark, str(path), "n", multiline=True).orderBy("x").collect()
    assert [(r.x, r.y, r.presence) for r in rows] == [(1.0, 2.0, 5), (3.0, 4.0, 0)]
    empty = tmp_path / "e.geojson"
    empty.write_text('{"type":"FeatureCollection","features":[]}')
    with pytest.raises(ValueError, match="no point"):
        read_geojson_points(spark, str(empty))


def test_surface_must_cover_the_grid(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, value double")
    with pytest.raises(ValueError, match="cover"):
        write_surface(df, str(tmp_path / "s"), Grid(0, 2, 1, 1, 2, 2))
    twice = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 0, 1.0)], "row int, col int, value double")
    with pytest.raises(ValueError, match="cover"):
        write_surface(twice, str(tmp_path / "s"), Grid(0, 2, 1, 1, 2, 2))
    with pytest.raises(ValueError, match="stored"):
        write_surface(df, str(tmp_path / "s"), Grid(0, 1, 1, 1, 1, 1), dtype="uint8")


def test_candidates_are_not_copied_for_their_neighbours(spark, monkeypatch):
    """Among dense presences a candidate is one row on the first level, with shuffle joins, and the answer is exact."""
    from nichefield.operators import nearby
    rng = np.random.default_rng(8)
    known, asked = np.floor(rng.uniform(-3, 3, (3000, 2)) * 8) / 8, rng.uniform(-4, 4, (400, 2))
    pres = spark.createDataFrame([(float(a), float(b)) for a, b in known], "x double, y double")
    cand = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(asked)], "i long, x double, y double")
    sizes, keep = [], nearby.checkpointed
    monkeypatch.setattr(nearby, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(nearby, "checkpointed", lambda df: (lambda out: sizes.append((out.columns, out.count())) or out)(keep(df)))
    got = {r.i for r in nearby.ids_within(cand, pres, 0.3, "i").collect()}
    near = np.sqrt(((asked[:, None] - known[None]) ** 2).sum(axis=2)).min(axis=1)
    assert got == set(np.flatnonzero(near <= 0.3).tolist())
    first = next(n for columns, n in sizes if "_hit" in columns)
    assert first <= len(asked)
