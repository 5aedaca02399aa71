"""Queries over points and cells: sources, column expressions, cleaning, background sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coordinates as co
from ..functions.scalars import binarise, complete_rows, with_cell
from ..operators import background as bg
from ..operators import cells as ce
from ..operators import clean as cl
from ..operators.common import shared_dir
from ..sources import read_geojson_points, read_points, read_surface, write_surface
from .tables import Data, r, tidy, uniform, with_tables

PREDICTORS = ["p1", "p2", "p3"]
QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
    return fn


def oracle(name: str, sql: str):
    ORACLES[name] = with_tables(sql)


def fresh_path(spark, name: str) -> str:
    import uuid
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


# --- sources -------------------------------------------------------------------------------

@query
def read_points_(d):
    path = fresh_path(d.spark, "points.csv")
    d.occ.withColumn("presence", F.col("presence") * 3 - 1).write.csv(path, header=True)
    return tidy(read_points(d.spark, path, presence="presence", rid="rid"))


QUERIES["read_points"] = QUERIES.pop("read_points_")
oracle("read_points", f"select rid, {r('x')}, {r('y')}, least(1, greatest(0, presence * 3 - 1)) as presence from fx_occ")


@query
def geojson_points(d):
    path = fresh_path(d.spark, "points.json")
    at = F.concat(F.lit("["), F.col("x"), F.lit(","), F.col("y"), F.lit("]"))
    kind = F.when(F.col("rid") % 11 == 0, "LineString").when(F.col("rid") % 3 == 0, "MultiPoint").otherwise("Point")
    where = F.when(kind == "Point", at).otherwise(F.concat(F.lit("["), at, F.lit(",[1.0,2.0]]")))
    geometry = F.when(F.col("x").isNull(), F.lit("null")).otherwise(F.concat(
        F.lit('{"type":"'), kind, F.lit('","coordinates":'), where, F.lit("}")))
    presence = F.when(F.col("rid") % 7 == 0, F.lit("{}")).otherwise(
        F.concat(F.lit('{"presence":'), F.col("presence") * 3, F.lit("}")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), presence, F.lit("}"))
    # A hundred features per collection, one collection per line.
    lines = d.occ.groupBy(F.floor(F.col("rid") / 100)).agg(F.concat_ws(",", F.collect_list(feature)).alias("f"))
    lines.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).write.text(path)
    points = read_geojson_points(d.spark, path, "presence")
    return tidy(points.groupBy("x", "y", "presence").agg(F.count(F.lit(1)).alias("n")))


oracle("geojson_points", f"""
select {r('x')}, {r('y')}, case when rid % 7 = 0 then 0 else presence * 3 end as presence, count(*) as n
from fx_occ where x is not null and rid % 11 <> 0 group by x, y, case when rid % 7 = 0 then 0 else presence * 3 end""")


@query
def stack_cells(d):
    return tidy(ce.build_cells(d.layer_values, d.layers))


oracle("stack_cells", f"""
select row, col, {r('col + 0.5e0', 'x')}, {r('{G} - (row + 0.5e0)', 'y')},
  {r("max(case when layer = 'p1' and value <> -9999 then value end)", 'p1')},
  {r("max(case when layer = 'p2' then value end)", 'p2')}
from fx_layer_values group by row, col""")


@query
def mask_nodata(d):
    return tidy(ce.mask_nodata(d.layer_values, d.layers))


oracle("mask_nodata", f"""
select layer, row, col, {r("case when layer = 'p1' and value = -9999 then null else value end", 'value')}
from fx_layer_values""")

_STATS = """
select layer, 'decimal' as kind, {mn}, {mx}, {av}, {sd}, count(value) as n_valid, {vf}, {flag} as sampled
from (select layer, row, col, case when layer = 'p1' and value = -9999 then null else value end as value
      from fx_layer_values where row % {s} = 0 and col % {s} = 0) t group by layer"""


def _stats_sql(stride: int) -> str:
    cells = f"(select ceil(g / {float(stride)}e0) * ceil(g / {float(stride)}e0) from fx_size)"
    return _STATS.format(mn=r("min(value)", "minimum"), mx=r("max(value)", "maximum"), av=r("avg(value)", "mean"),
                         sd=r("stddev_pop(value)", "sd"), vf=r(f"count(value) / {cells}", "valid_fraction"),
                         flag="true" if stride > 1 else "false", s=stride)


@query
def layer_stats(d):
    return tidy(ce.layer_stats(d.layer_values, d.layers))


@query
def layer_stats_strided(d):
    return tidy(ce.layer_stats(d.layer_values, d.layers, sample_cap=d.side * d.side / 4))


oracle("layer_stats", _stats_sql(1))
oracle("layer_stats_strided", _stats_sql(2))


@query
def surface_encoded(d):
    """Written and read back as stored."""
    path = fresh_path(d.spark, "surface")
    grid, keys = d.grid, ["algorithm", "replicate"]
    from ..operators.regrid import target_cells
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    asked = target_cells(d.spark, grid).withColumn("algorithm", each(("lr", "rf", "enfa"))).withColumn("replicate", each((0, 1, 2)))
    whole = asked.join(d.preds.select(*keys, F.col("row").cast("int"), F.col("col").cast("int"), "value"), [*keys, "row", "col"], "left")
    write_surface(whole, path, grid, keys=keys)
    return tidy(d.spark.read.parquet(path).select(*keys, "row", "col", "value"))


oracle("surface_encoded", f"""
select algorithm, replicate, cast(i // g as int) as row, cast(i % g as int) as col, {r('cast(cast(coalesce(value, -9999) as float) as double)', 'value')}
from (select *, unnest(range(0, g * g)) as i from (select *, unnest([0, 1, 2]) as replicate
  from (select g, unnest(['lr', 'rf', 'enfa']) as algorithm from fx_size) a) b) c
left join (select row as r, col as k, value, algorithm as a, replicate as rep from fx_preds) p
  on a = algorithm and rep = replicate and r = i // g and k = i % g""")


@query
def surface_roundtrip(d):
    """Stored with markers, read back with NULLs."""
    path = fresh_path(d.spark, "surface")
    ce.surface_encoded(d.preds, dtype="float64").write.parquet(path)
    return tidy(read_surface(d.spark, path).groupBy("algorithm", "replicate").agg(
        F.count("value").alias("n_valid"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


oracle("surface_roundtrip", f"""
select algorithm, replicate, count(value) as n_valid, count(*) as n, {r('avg(value)', 'mean')}
from fx_preds group by algorithm, replicate""")


# --- column expressions --------------------------------------------------------------------

@query
def reproject_utm(d):
    lonlat = d.occ.where("x is not null").select("rid", (F.col("x") * 0.1 + 12).alias("x"), (F.col("y") * 0.1 + 40).alias("y"))
    return tidy(co.reproject(lonlat, "EPSG:4326", "EPSG:32633"), 3)


oracle("reproject_utm", f"""
with k as (select 1 / 298.257223563e0 as f),
k2 as (select f / (2 - f) as n from k),
k3 as (select n, 6378137e0 / (1 + n) * (1 + n*n/4 + n*n*n*n/64) * 0.9996e0 as s, 2 * sqrt(n) / (1 + n) as q,
  n/2 - 2*n*n/3 + 5*n*n*n/16 as a1, 13*n*n/48 - 3*n*n*n/5 as a2, 61*n*n*n/240 as a3 from k2),
p as (select rid, radians(y * 0.1e0 + 40) as phi, radians(x * 0.1e0 + 12) - radians(15e0) as lam from fx_occ where x is not null),
t as (select p.*, k3.*, sinh(atanh(sin(phi)) - q * atanh(q * sin(phi))) as t from p, k3),
e as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t*t)) as eta from t)
select rid,
  {r('500000 + s * (eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta))', 'x', 3)},
  {r('s * (xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta))', 'y', 3)}
from e""")


@query
def reproject_back(d):
    """To UTM and the web map and back again: the starting degrees."""
    lonlat = d.occ.where("x is not null").select("rid", (F.col("x") * 0.1 + 12).alias("x"), (F.col("y") * 0.1 + 40).alias("y"))
    there = co.reproject(co.reproject(lonlat, "EPSG:4326", "EPSG:32633"), "EPSG:32633", "EPSG:3857")
    return tidy(co.reproject(there, "EPSG:3857", "EPSG:4326"), 5)


oracle("reproject_back", f"select rid, {r('x * 0.1e0 + 12', 'x', 5)}, {r('y * 0.1e0 + 40', 'y', 5)} from fx_occ where x is not null")


@query
def meters_per_degree(d):
    lat = (F.col("y") * 2 - 40).alias("lat")
    return tidy(d.occ.select("rid", lat, co.meters_per_degree(F.col("y") * 2 - 40).alias("meters")), 4)


_MPD = "111132.92e0 - 559.82e0 * cos(2 * radians({0})) + 1.175e0 * cos(4 * radians({0})) - 0.0023e0 * cos(6 * radians({0}))"
oracle("meters_per_degree", f"select rid, {r('y * 2 - 40', 'lat', 4)}, {r(_MPD.format('(y * 2 - 40)'), 'meters', 4)} from fx_occ")


@query
def crs_units(d):
    return tidy(d.occ.select("rid", co.to_crs_units(F.col("y") * 1000, "EPSG:4326", F.col("y")).alias("degrees"),
                             co.to_meters(F.col("y"), "EPSG:4326", F.col("y")).alias("meters"),
                             co.to_crs_units(F.col("y") * 1000, "EPSG:32633", F.col("y")).alias("projected")), 4)


oracle("crs_units", f"""
select rid, {r('y * 1000 / (' + _MPD.format('y') + ')', 'degrees', 4)}, {r('y * (' + _MPD.format('y') + ')', 'meters', 4)},
  {r('y * 1000', 'projected', 4)} from fx_occ""")


@query
def point_to_cell(d):
    return d.occ.transform(with_cell, d.grid).select("rid", "row", "col")


oracle("point_to_cell", "select rid, cast(floor({G} - y) as bigint) as row, cast(floor(x) as bigint) as col from fx_occ")


@query
def extract_values(d):
    return tidy(ce.extract_at(d.occ, d.cells, d.grid, PREDICTORS).select("rid", *PREDICTORS))


_SEEN = """seen as (select o.*, c.row, c.col, c.p1, c.p2, c.p3 from fx_occ o
  left join fx_cells c on c.row = floor({G} - o.y) and c.col = floor(o.x))"""
oracle("extract_values", f"with {_SEEN} select rid, {r('p1')}, {r('p2')}, {r('p3')} from seen")


@query
def complete_rows_(d):
    return tidy(complete_rows(d.cells, PREDICTORS))


QUERIES["complete_rows"] = QUERIES.pop("complete_rows_")
oracle("complete_rows", f"""
select row, col, {r('x')}, {r('y')}, {r('p1')}, {r('p2')}, {r('p3')} from fx_cells
where p1 is not null and p2 is not null and p3 is not null""")


@query
def standardised(d):
    return tidy(ce.add_squares(ce.standardise(d.matrix.select("pid", "a", "d", "konst"), ["a", "d", "konst"]), ["a", "d"]))


oracle("standardised", f"""
with s as (select avg(a) as ma, stddev_pop(a) as sa, avg(d) as md, stddev_pop(d) as sd from fx_matrix)
select pid, {r('(a - ma) / sa', 'a')}, {r('(d - md) / sd', 'd')}, 0e0 as konst,
  {r('((a - ma) / sa) * ((a - ma) / sa)', 'a_sq')}, {r('((d - md) / sd) * ((d - md) / sd)', 'd_sq')} from fx_matrix, s""")


@query
def binarise_(d):
    return binarise(d.oof, 0.5, "score").select("pid", "algorithm", "replicate", "binary")


@query
def binarise_masked(d):
    return binarise(d.preds, 0.5, missing=255).select("row", "col", "algorithm", "replicate", "binary")


QUERIES["binarise"] = QUERIES.pop("binarise_")
oracle("binarise", "select pid, algorithm, replicate, case when score >= 0.5 then 1 else 0 end as binary from fx_oof")
oracle("binarise_masked", """select row, col, algorithm, replicate,
  case when value is null then 255 when value >= 0.5 then 1 else 0 end as binary from fx_preds""")


# --- cleaning ------------------------------------------------------------------------------

def _judged(keys: str = "") -> str:
    """Records with the first rule each one fails."""
    by = f"{keys}, " if keys else ""
    return f"""{_SEEN},
ranked as (select *, row_number() over (partition by {by}x, y order by rid) as nth from seen),
judged as (select *, case when x is null or y is null then 'nan_coords' when nth > 1 then 'duplicate'
  when x = 0 and y = 0 then 'zero_zero'
  when x < 0 or x > {{G}} or y < 0 or y > {{G}} then 'out_of_extent'
  when p1 is null or p2 is null or p3 is null then 'nodata_cell' end as rule from ranked)"""


@query
def clean_points(d):
    return tidy(cl.clean_points(d.occ, d.cells, d.grid))


@query
def clean_points_by_species(d):
    return tidy(cl.clean_points(d.occ, d.cells, d.grid, keys=["species"]))


oracle("clean_points", f"with {_judged()} select rid, species, {r('x')}, {r('y')}, presence from judged where rule is null")
oracle("clean_points_by_species",
       f"with {_judged('species')} select rid, species, {r('x')}, {r('y')}, presence from judged where rule is null")


@query
def clean_report(d):
    return cl.clean_report(d.occ, d.cells, d.grid)


@query
def clean_report_by_species(d):
    return cl.clean_report(d.occ, d.cells, d.grid, ["species"])


oracle("clean_report", f"""with {_judged()}
select rule, count(*) as dropped, (select count(*) from judged) as n_input,
  (select count(*) from judged where rule is null) as n_output from judged where rule is not null group by rule""")
oracle("clean_report_by_species", f"""with {_judged('species')},
t as (select species, count(*) as n_input, count(*) filter (rule is null) as n_output from judged group by species)
select j.species, rule, count(*) as dropped, max(n_input) as n_input, max(n_output) as n_output
from judged j join t on t.species = j.species where rule is not null group by j.species, rule""")


@query
def thin_points(d):
    return tidy(cl.thin_points(d.occ.where("x is not null"), d.grid))


@query
def thin_points_by_species(d):
    return tidy(cl.thin_points(d.occ.where("x is not null"), d.grid, ["species"]))


_THIN = """select rid, species, {x}, {y}, presence from (select *, row_number() over (
  partition by {by}floor({{G}} - y), floor(x), presence order by rid) as nth from fx_occ where x is not null) t where nth = 1"""
oracle("thin_points", _THIN.format(x=r("x"), y=r("y"), by="").replace("{{G}}", "{G}"))
oracle("thin_points_by_species", _THIN.format(x=r("x"), y=r("y"), by="species, ").replace("{{G}}", "{G}"))


@query
def thin_report(d):
    return cl.thin_report(d.occ.where("x is not null"), d.grid)


oracle("thin_report", """
select cast(sum(n) as bigint) as n_input, count(*) as n_output, cast(sum(n) as bigint) - count(*) as n_removed
from (select count(*) as n from fx_occ where x is not null group by floor({G} - y), floor(x), presence) t""")


@query
def removed_fraction(d):
    return tidy(cl.removed_fraction(d.occ, cl.thin_points(cl.clean_points(d.occ, d.cells, d.grid), d.grid)))


@query
def removed_fraction_by_species(d):
    clean = cl.clean_points(d.occ, d.cells, d.grid, ["species"])
    return tidy(cl.removed_fraction(d.occ, cl.thin_points(clean, d.grid, ["species"]), ["species"]))


oracle("removed_fraction", f"""with {_judged()}, f as (select count(*) as n_final from (
  select distinct row, col, presence from judged where rule is null) t),
w as (select count(*) as n_raw from fx_occ)
select n_raw, n_final, {r('1 - n_final / n_raw', 'removed')} from f, w""")
oracle("removed_fraction_by_species", f"""with {_judged('species')}, f as (select species, count(*) as n_final from (
  select distinct species, row, col, presence from judged where rule is null) t group by species),
w as (select species, count(*) as n_raw from fx_occ group by species)
select w.species, n_raw, n_final, {r('1 - n_final / n_raw', 'removed')} from f join w on w.species = f.species""")


@query
def cleaned_values(d):
    """Cleaned, thinned records with their predictor values."""
    clean = cl.clean_points(d.occ, d.cells, d.grid)
    thin = cl.thin_points(clean, d.grid)
    return tidy(ce.extract_at(thin, d.cells, d.grid, PREDICTORS).select("rid", "x", "y", "presence", *PREDICTORS))


oracle("cleaned_values", f"""with {_judged()}
select rid, {r('x')}, {r('y')}, presence, {r('p1')}, {r('p2')}, {r('p3')} from (
  select *, row_number() over (partition by row, col, presence order by rid) as k from judged where rule is null) t
where k = 1""")


# --- background ----------------------------------------------------------------------------

def _presences(d):
    return d.occ.where("presence = 1 and x is not null")


def _half(d, keys=()):
    return bg.background_count(d.occ, "ratio", ratio=0.5, keys=keys)


_PRES = "pres as (select x, y, species from fx_occ where presence = 1 and x is not null)"
_N = "wanted as (select cast(greatest(1, floor(count(*) * 0.5e0 + 0.5e0)) as bigint) as n from fx_occ where presence = 1)"


def _drawn(box: str = "0e0, 0e0, {G}, {G}", factor: int = 4) -> str:
    """Candidates of the seeded sequence over a box."""
    x0, y0, x1, y1 = box.split(", ")
    ux, uy = uniform("'42:' || i || ':x'"), uniform("'42:' || i || ':y'")
    return f"""{_N},
ids as (select unnest(range(0, (select n * {factor} + 3000 from wanted))) as i),
drawn as (select i, {x0} + {ux} * ({x1} - {x0}) as x, {y0} + {uy} * ({y1} - {y0}) as y from ids),
valued as (select d.i, d.x, d.y, c.p1, c.p2, c.p3 from drawn d
  join fx_cells c on c.row = floor({{G}} - d.y) and c.col = floor(d.x) where c.p1 is not null)"""


_FIRST = "select i, {x}, {y} from (select *, row_number() over (order by i) as k from accepted) t where k <= (select n from wanted)"
_FIRST = _FIRST.format(x=r("x"), y=r("y"))


@query
def background_count(d):
    return bg.background_count(d.occ, "ratio", ratio=1.5, keys=["species"])


oracle("background_count", """
select species, n_presence, cast(greatest(1, floor(n_presence * 1.5e0 + 0.5e0)) as bigint) as n
from (select species, count(*) filter (presence = 1) as n_presence from fx_occ group by species) t""")


@query
def background_random(d):
    return tidy(bg.background_random(d.cells, d.grid, 2 * d.side * d.side, PREDICTORS))


oracle("background_random", f"""
with wanted as (select cast(2 * g * g as bigint) as n from fx_size),
{_drawn().split('wanted as', 1)[1].split('),', 1)[1].strip()}, accepted as (select * from valued)
{_FIRST}""")


@query
def background_ratio(d):
    return tidy(bg.background_random(d.cells, d.grid, _half(d), PREDICTORS))


oracle("background_ratio", f"with {_drawn()}, accepted as (select * from valued) {_FIRST}")


@query
def background_by_species(d):
    return tidy(bg.background_random(d.cells, d.grid, _half(d, ["species"]), PREDICTORS, keys=["species"]))


_UX = uniform("'42:' || species || ':' || i || ':x'")
_UY = uniform("'42:' || species || ':' || i || ':y'")
oracle("background_by_species", f"""
with wanted as (select species, cast(greatest(1, floor(count(*) * 0.5e0 + 0.5e0)) as bigint) as n
  from fx_occ where presence = 1 group by species),
ids as (select species, n, unnest(range(0, n * 4 + 3000)) as i from wanted),
drawn as (select species, n, i, {_UX} * {{G}} as x, {_UY} * {{G}} as y from ids),
ranked as (select d.*, row_number() over (partition by species order by i) as k from drawn d
  join fx_cells c on c.row = floor({{G}} - d.y) and c.col = floor(d.x) where c.p1 is not null)
select species, i, {r('x')}, {r('y')} from ranked where k <= n""")

LOW, HIGH = 0.3, 0.6


@query
def background_disk(d):
    return tidy(bg.background_disk(_presences(d), d.cells, d.grid, _half(d), PREDICTORS, LOW, HIGH))


@query
def background_buffered(d):
    return tidy(bg.background_buffered(_presences(d), d.cells, d.grid, _half(d), PREDICTORS, LOW))


@query
def background_disk_by_species(d):
    return tidy(bg.background_disk(_presences(d), d.cells, d.grid, _half(d, ["species"]), PREDICTORS, 0.5, 1.5,
                                   keys=["species"]))


def _ring(low: float, high: float, factor: int = 12) -> str:
    edge = [f"(select greatest(0e0, min(x) - {high}) from pres)", f"(select greatest(0e0, min(y) - {high}) from pres)",
            f"(select least({{G}}, max(x) + {high}) from pres)", f"(select least({{G}}, max(y) + {high}) from pres)"]
    body = _drawn("X0, Y0, X1, Y1", factor)
    for name, text in zip(("X0", "Y0", "X1", "Y1"), edge):
        body = body.replace(name, text)
    return f"""with {_PRES}, {body},
near as (select v.i, min((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y)) as d2
  from valued v join pres p on p.x between v.x - {high} and v.x + {high} and p.y between v.y - {high} and v.y + {high}
  group by v.i),
accepted as (select v.* from valued v join near n on n.i = v.i where d2 <= {high * high}e0 and d2 >= {low * low}e0)
{_FIRST}"""


oracle("background_disk", _ring(LOW, HIGH))
oracle("background_buffered", _ring(0.0, LOW))
oracle("background_disk_by_species", f"""
with {_PRES}, wanted as (select species, cast(greatest(1, floor(count(*) * 0.5e0 + 0.5e0)) as bigint) as n
  from fx_occ where presence = 1 group by species),
box as (select species, greatest(0e0, min(x) - 1.5e0) as x0, greatest(0e0, min(y) - 1.5e0) as y0,
  least({{G}}, max(x) + 1.5e0) as x1, least({{G}}, max(y) + 1.5e0) as y1 from pres group by species),
ids as (select w.species, n, x0, y0, x1, y1, unnest(range(0, n * 6 + 3000)) as i from wanted w join box b on b.species = w.species),
drawn as (select species, n, i, x0 + {_UX} * (x1 - x0) as x, y0 + {_UY} * (y1 - y0) as y from ids),
valued as (select d.* from drawn d join fx_cells c on c.row = floor({{G}} - d.y) and c.col = floor(d.x) where c.p1 is not null),
near as (select v.species, v.i, min((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y)) as d2
  from valued v join pres p on p.species = v.species and p.x between v.x - 1.5 and v.x + 1.5 and p.y between v.y - 1.5 and v.y + 1.5
  group by v.species, v.i),
ranked as (select v.*, row_number() over (partition by v.species order by v.i) as k from valued v
  join near n on n.i = v.i and n.species = v.species where d2 between 0.25e0 and 2.25e0)
select species, i, {r('x')}, {r('y')} from ranked where k <= n""")

Q = 0.1


@query
def presence_envelope(d):
    seen = ce.extract_at(d.occ, d.cells, d.grid, PREDICTORS)
    return tidy(bg.presence_envelope(seen, PREDICTORS, Q, ["species"]))


_BOUNDS = ", ".join(f"quantile_cont({p}, {Q}e0) as {p}_low, quantile_cont({p}, {1 - Q}e0) as {p}_high" for p in PREDICTORS)
_ENV = f"""env as (select species, count(*) as n_used, {_BOUNDS} from seen
  where presence = 1 and p1 is not null and p2 is not null and p3 is not null group by species)"""
oracle("presence_envelope", f"with {_SEEN}, {_ENV} select species, n_used, "
       + ", ".join(f"{r(p + '_low')}, {r(p + '_high')}" for p in PREDICTORS) + " from env")


@query
def background_sre(d):
    return tidy(bg.background_sre(d.occ.where("x is not null"), d.cells, d.grid, _half(d), PREDICTORS, Q))


oracle("background_sre", f"""
with {_SEEN}, {_ENV.replace('species, count', 'count').replace(' group by species', '')}, {_drawn(factor=8)},
accepted as (select v.* from valued v, env where p2 is not null and p3 is not null and (
  p1 < p1_low or p1 > p1_high or p2 < p2_low or p2 > p2_high or p3 < p3_low or p3 > p3_high))
{_FIRST}""")


def labelled(d):
    """Presences and ratio background of the whole tables."""
    points = d.occ.where("x is not null")
    return bg.label_points(points, bg.background_random(d.cells, d.grid, _half(d), PREDICTORS), d.cells, d.grid, PREDICTORS)


LABELLED = f"""with {_drawn()},
first as (select * from (select *, row_number() over (order by i) as k from valued) t where k <= (select n from wanted)),
joined as (select 'o' || rid as pid, x, y, 1 as label from fx_occ where presence = 1 and x is not null
  union all select 'b' || i as pid, x, y, 0 as label from first),
labelled as (select b.*, cast(c.row as bigint) as row, cast(c.col as bigint) as col, p1, p2, p3 from joined b
  join fx_cells c on c.row = floor({{G}} - b.y) and c.col = floor(b.x)
  where p1 is not null and p2 is not null and p3 is not null)"""


@query
def labelled_points(d):
    return tidy(labelled(d))


oracle("labelled_points", f"""{LABELLED} select pid, {r('x')}, {r('y')}, row, col, label, {r('p1')}, {r('p2')}, {r('p3')}
from labelled""")


@query
def background_shortfall(d):
    return bg.shortfall(labelled(d), _half(d))


oracle("background_shortfall", f"""{LABELLED}, t as (select count(*) filter (label = 0) as drawn from labelled)
select n as requested, drawn, greatest(0, n - drawn) as missing from wanted, t""")
