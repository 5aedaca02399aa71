"""Queries over surfaces: prediction, ensembles, transfer, regridding, notes and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..grid import Grid
from ..models import fit
from ..operators import ensemble as ens
from ..operators import evaluate as ev
from ..operators import surfaces as su
from ..operators import transfer as tr
from ..operators.common import attach, checkpointed
from ..operators.notes import headline, run_notes
from ..operators.quantiles import quantiles
from ..operators.regrid import regrid
from ..plans.run import Settings, run
from .modelling import _SUMMARY, ENSEMBLE_OOF, _equal, _evaluation, _METRICS, enfa_sql
from .points import LABELLED, fresh_path, labelled
from .tables import Data, r, tidy, with_tables

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__.rstrip("_")] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
    return fn


def oracle(name: str, sql: str):
    ORACLES[name] = with_tables(sql)


# --- prediction and ensemble ---------------------------------------------------------------

@query
def predict_surface(d):
    m = fit("enfa", checkpointed(labelled(d)), ["p1", "p3"])
    return tidy(su.predict_surface(m, d.cells))


@query
def project_surface(d):
    m = fit("enfa", checkpointed(labelled(d)), ["p1", "p3"])
    return tidy(su.predict_surface(m, d.future))


def _projected(target: str) -> str:
    return f"""{LABELLED}, {enfa_sql('labelled', target, 't.row, t.col', 'p1', 'p3')}
select 'enfa' as algorithm, 0 as replicate, row, col, {r('score', 'value')} from scored"""


oracle("predict_surface", _projected("fx_cells"))
oracle("project_surface", _projected("fx_future"))


@query
def mean_surface(d):
    return tidy(ens.mean_surface(d.preds))


oracle("mean_surface", f"select algorithm, row, col, {r('avg(value)', 'value')} from fx_preds group by algorithm, row, col")


@query
def ensemble_weights(d):
    return tidy(ens.ensemble_weights(ev.summarise_metrics(d.metrics, ["species"]), keys=["species"]))


@query
def ensemble_weights_auc(d):
    return tidy(ens.ensemble_weights(ev.summarise_metrics(d.metrics, ["species"]), "weighted_auc", ["species"]))


@query
def ensemble_weights_mean(d):
    return tidy(ens.ensemble_weights(ev.summarise_metrics(d.metrics, ["species"]), "mean", ["species"]))


def _weights(metric: str) -> str:
    return f"""with {_SUMMARY}, raw as (select species, algorithm, greatest(0, coalesce({metric}, 0)) as w from summary),
t as (select species, sum(w) as s, count(*) as n from raw group by species)
select t.species, algorithm, {r('case when s > 0 then w / s else 1e0 / n end', 'weight')} from raw join t on t.species = raw.species"""


oracle("ensemble_weights", _weights("tss_mean"))
oracle("ensemble_weights_auc", _weights("auc_mean"))
oracle("ensemble_weights_mean", _weights("1e0"))


def _fixed_weights(d):
    """Weights that follow the predictions themselves: the share of values an algorithm has."""
    per = d.preds.groupBy("algorithm").agg(F.count("value").alias("n"))
    return per.select("algorithm", F.when(F.col("algorithm") == "rf", 0.0).otherwise(
        F.when(F.col("algorithm") == "lr", 0.75).otherwise(0.25)).alias("weight"))


def _ensemble(d):
    return ens.ensemble_surface(ens.mean_surface(d.preds), _fixed_weights(d))


@query
def ensemble_surface(d):
    return tidy(_ensemble(d))


_ENSEMBLE = """m as (select algorithm, row, col, avg(value) as v,
  case algorithm when 'rf' then 0e0 when 'lr' then 0.75e0 else 0.25e0 end as w from fx_preds group by algorithm, row, col),
ensemble as (select row, col, case when count(v) > 0 then coalesce(sum(v * w), 0) /
  case when coalesce(sum(w) filter (v is not null), 0) > 0 then sum(w) filter (v is not null) else 1 end end as value,
  stddev_pop(v) as sd from m group by row, col)"""
oracle("ensemble_surface", f"with {_ENSEMBLE} select row, col, {r('value')}, {r('sd')} from ensemble")


@query
def ensemble_wide(d):
    """The same ensemble with algorithms side by side in each cell's row: no shuffle after the pivot."""
    wide = d.preds.groupBy("row", "col").pivot("algorithm", ["lr", "rf", "enfa"]).agg(F.avg("value"))
    return tidy(su.ensemble_wide(wide, {"lr": 0.75, "rf": 0.0, "enfa": 0.25}, 0.5,
                                  own_thresholds={"lr": 0.4, "enfa": 0.6}).drop("lr", "rf", "enfa"))


oracle("ensemble_wide", f"""with {_ENSEMBLE}, own as (select row, col, max(v) filter (algorithm = 'lr') as lr, max(v) filter (algorithm = 'enfa') as enfa from m group by row, col)
select e.row, e.col, {r('e.value', 'value')}, {r('e.sd', 'sd')}, case when e.value is null then 255 when e.value >= 0.5e0 then 1 else 0 end as binary,
  case when lr is null then 255 when lr >= 0.4e0 then 1 else 0 end as lr_binary, case when enfa is null then 255 when enfa >= 0.6e0 then 1 else 0 end as enfa_binary
from ensemble e join own o on o.row = e.row and o.col = e.col""")


@query
def ensemble_threshold(d):
    return tidy(ens.ensemble_threshold(d.metrics, ["species"]))


oracle("ensemble_threshold", f"""select species, {r('coalesce(avg(t), 0.5e0)', 'threshold')}
from (select species, algorithm, avg(threshold) as t from fx_metrics group by species, algorithm) x group by species""")


@query
def ensemble_cv(d):
    return tidy(ens.ensemble_cv(d.oof, _equal(d)))


oracle("ensemble_cv", f"""with {ENSEMBLE_OOF}, {_evaluation('ens', 'replicate')}
select replicate, {_METRICS} from ranked left join index using (replicate)""")


@query
def ensemble_curves(d):
    weights = _fixed_weights(d).withColumn("weight", F.col("weight") + 0.1)
    return tidy(ens.ensemble_curves(ens.curve_bands(d.curves), weights, ["lr", "rf", "enfa"]), 9)


oracle("ensemble_curves", f"""
with w as (select * from (values ('lr', 0.85e0), ('rf', 0.1e0), ('enfa', 0.35e0)) t(algorithm, w)),
b as (select algorithm, feature, grid_i, min_by(grid_v, replicate) as gv, avg(pred) as m from fx_curves group by algorithm, feature, grid_i),
lead_alg as (select feature, min_by(algorithm, case algorithm when 'lr' then 1 when 'rf' then 2 else 3 end) as algorithm from b group by feature),
grid as (select b.feature, grid_i, gv as g from b join lead_alg f on f.feature = b.feature and f.algorithm = b.algorithm),
ends as (select algorithm, feature, min(gv) as lo, max(gv) as hi, min_by(m, gv) as mlo, max_by(m, gv) as mhi from b group by algorithm, feature),
seg as (select algorithm, feature, gv as x0, m as y0, lead(gv) over o as x1, lead(m) over o as y1 from b
  window o as (partition by algorithm, feature order by gv)),
val as (select g.feature, grid_i, g, e.algorithm, case when g <= lo then mlo when g >= hi then mhi
  else y0 + (g - x0) * (y1 - y0) / (x1 - x0) end as v
  from grid g join ends e on e.feature = g.feature
  left join seg s on s.feature = g.feature and s.algorithm = e.algorithm and s.x1 is not null and g >= x0 and g < x1),
tot as (select feature, sum(w) as s from ends join w using (algorithm) group by feature)
select val.feature, grid_i, {r('min(g)', 'grid_v', 9)}, {r('sum(v * w / s)', 'pred', 9)}
from val join w using (algorithm) join tot on tot.feature = val.feature group by val.feature, grid_i""")


@query
def surface_shares(d):
    return tidy(ens.surface_shares(_ensemble(d), 0.45))


oracle("surface_shares", f"""with {_ENSEMBLE} select {r('avg(case when sd is not null then cast(sd > 0.2e0 as int) end)', 'disagreement_share')},
  {r('avg(case when value is not null then cast(value >= 0.45e0 as int) end)', 'suitable_share')} from ensemble""")


# --- transfer ------------------------------------------------------------------------------

def _train(d):
    """Training records: the distinct present-day cells the presences stand on."""
    at = d.occ.where("presence = 1 and x is not null").select(
        F.floor(d.side - F.col("y")).cast("int").alias("row"), F.floor("x").cast("int").alias("col")).distinct()
    return d.cells.join(at, ["row", "col"], "left_semi")


P3 = ["p1", "p2", "p3"]
_TRAIN = """train as (select * from fx_cells c where p1 is not null and p2 is not null and p3 is not null and exists (
  select 1 from fx_occ o where presence = 1 and x is not null and c.row = floor({G} - o.y) and c.col = floor(o.x)))"""


@query
def mess(d):
    return tidy(tr.mess(d.future, _train(d), P3))


@query
def mess_shuffled(d):
    """The form for training sets too large to broadcast."""
    return tidy(tr.mess(d.future, _train(d), P3, broadcast_values=0))


def _similar(p: str) -> str:
    return f"""s_{p} as (select row, col, case when {p} < lo then ({p} - lo) / greatest(hi - lo, 1e-9) * 100
  when {p} > hi then (hi - {p}) / greatest(hi - lo, 1e-9) * 100 else least(f, n - f) / n * 200 end as s
  from (select c.row, c.col, c.{p}, count(t.{p}) as f, max(lo) as lo, max(hi) as hi, max(n) as n from fx_future c
    join (select min({p}) as lo, max({p}) as hi, count(*) as n from train) b on true
    left join train t on t.{p} <= c.{p} where c.{p} is not null group by c.row, c.col, c.{p}) x)"""


_MESS = f"""{_TRAIN}, {_similar('p1')}, {_similar('p2')}, {_similar('p3')},
mess as (select c.row, c.col, case when c.p1 is not null and c.p2 is not null and c.p3 is not null
  then least(a.s, b.s, e.s) end as mess from fx_future c left join s_p1 a on a.row = c.row and a.col = c.col
  left join s_p2 b on b.row = c.row and b.col = c.col left join s_p3 e on e.row = c.row and e.col = c.col)"""
oracle("mess", f"with {_MESS} select row, col, {r('mess')} from mess")
ORACLES["mess_shuffled"] = ORACLES["mess"]


@query
def mess_by_key(d):
    """Each half of the map compared with its own training records."""
    half = (F.col("col") * 2 >= d.side).cast("int").alias("half")
    return tidy(tr.mess(d.future.select("*", half), _train(d).select("*", half), P3, keys=["half"]))


def _zone(d):
    """Keys with a null group, one without training records (3) and one without cells (4)."""
    third = F.col("col") * 3 / F.lit(d.side)
    cells = F.when(third < 1, F.lit(0)).when(third < 2, F.lit(None)).otherwise(F.lit(3)).cast("int").alias("zone")
    known = F.when(third < 1, F.lit(0)).when(third < 2, F.lit(None)).otherwise(F.lit(4)).cast("int").alias("zone")
    return d.future.select("*", cells), _train(d).select("*", known)


@query
def mess_by_zone(d):
    return tidy(tr.mess(*_zone(d), P3, keys=["zone"]))


@query
def mess_by_zone_shuffled(d):
    return tidy(tr.mess(*_zone(d), P3, keys=["zone"], broadcast_values=0))


def _by_zone(p: str) -> str:
    return f"""s_{p} as (select row, col, case when {p} < lo then ({p} - lo) / greatest(hi - lo, 1e-9) * 100
  when {p} > hi then (hi - {p}) / greatest(hi - lo, 1e-9) * 100 else least(f, n - f) / n * 200 end as s
  from (select c.row, c.col, c.{p}, count(t.{p}) as f, max(lo) as lo, max(hi) as hi, max(n) as n from future c
    join (select zone, min({p}) as lo, max({p}) as hi, count(*) as n from th group by zone) b on b.zone is not distinct from c.zone
    left join th t on t.zone is not distinct from c.zone and t.{p} <= c.{p} where c.{p} is not null group by c.row, c.col, c.{p}) x)"""


for _name in ("mess_by_zone", "mess_by_zone_shuffled"):
    oracle(_name, f"""with {_TRAIN}, th as (select *, case when col * 3 < {{G}} then 0 when col * 3 < {{G}} * 2 then null else 4 end as zone from train),
future as (select *, case when col * 3 < {{G}} then 0 when col * 3 < {{G}} * 2 then null else 3 end as zone from fx_future),
{_by_zone('p1')}, {_by_zone('p2')}, {_by_zone('p3')}
select zone, c.row, c.col, {r('case when c.p1 is not null and c.p2 is not null and c.p3 is not null then least(a.s, b.s, e.s) end', 'mess')}
from future c left join s_p1 a on a.row = c.row and a.col = c.col
  left join s_p2 b on b.row = c.row and b.col = c.col left join s_p3 e on e.row = c.row and e.col = c.col""")


def _zone_quantiles(d, **options):
    """Quantiles per zone of the map, one without a value and one null."""
    third = F.col("col") * 3 / F.lit(d.side)
    zone = F.when(third < 1, F.lit(0)).when(third < 2, F.lit(None)).otherwise(F.lit(3)).cast("int")
    rows = d.cells.select(zone.alias("zone"), F.when(third < 2, F.col("p1")).alias("p1"), "p2")
    q = quantiles(rows, ["p1", "p2"], [0.25, 0.9], ["zone"], count="n", **options)
    return tidy(q.select("zone", "n", *[F.col(p)[i].alias(f"{p}_{i}") for p in ("p1", "p2") for i in (0, 1)]))


@query
def quantiles_by_zone(d):
    return _zone_quantiles(d)


@query
def quantiles_by_zone_ranked(d):
    return _zone_quantiles(d, in_task_rows=0)


for _name in ("quantiles_by_zone", "quantiles_by_zone_ranked"):
    oracle(_name, f"""select case when col * 3 < {{G}} then 0 when col * 3 < {{G}} * 2 then null else 3 end as zone, count(*) as n,
  {r('quantile_cont(case when col * 3 < {G} * 2 then p1 end, 0.25e0)', 'p1_0')}, {r('quantile_cont(case when col * 3 < {G} * 2 then p1 end, 0.9e0)', 'p1_1')},
  {r('quantile_cont(p2, 0.25e0)', 'p2_0')}, {r('quantile_cont(p2, 0.9e0)', 'p2_1')} from fx_cells group by 1""")


def _by_half(p: str) -> str:
    return f"""s_{p} as (select row, col, case when {p} < lo then ({p} - lo) / greatest(hi - lo, 1e-9) * 100
  when {p} > hi then (hi - {p}) / greatest(hi - lo, 1e-9) * 100 else least(f, n - f) / n * 200 end as s
  from (select c.row, c.col, c.{p}, count(t.{p}) as f, max(lo) as lo, max(hi) as hi, max(n) as n from future c
    join (select half, min({p}) as lo, max({p}) as hi, count(*) as n from th group by half) b on b.half = c.half
    left join th t on t.half = c.half and t.{p} <= c.{p} where c.{p} is not null group by c.row, c.col, c.{p}) x)"""


oracle("mess_by_key", f"""with {_TRAIN}, th as (select *, cast(col * 2 >= {{G}} as int) as half from train),
future as (select *, cast(col * 2 >= {{G}} as int) as half from fx_future), {_by_half('p1')}, {_by_half('p2')}, {_by_half('p3')}
select half, c.row, c.col, {r('case when c.p1 is not null and c.p2 is not null and c.p3 is not null then least(a.s, b.s, e.s) end', 'mess')}
from future c left join s_p1 a on a.row = c.row and a.col = c.col
  left join s_p2 b on b.row = c.row and b.col = c.col left join s_p3 e on e.row = c.row and e.col = c.col""")


@query
def mop(d):
    return tidy(tr.mop(d.future, _train(d), P3))


@query
def mop_blocked(d):
    """The form for training sets too large to broadcast."""
    return tidy(tr.mop(d.future, _train(d), P3, broadcast_values=0))


oracle("mop", f"""with {_TRAIN}, s as (select avg(p1) as m1, stddev_pop(p1) as s1, avg(p2) as m2, stddev_pop(p2) as s2, avg(p3) as m3,
  stddev_pop(p3) as s3, greatest(1, round_even(count(*) * 0.1e0, 0)) as k from train),
dist as (select c.row, c.col, sqrt(((c.p1 - t.p1) / s1) ** 2 + ((c.p2 - t.p2) / s2) ** 2 + ((c.p3 - t.p3) / s3) ** 2) as d, k
  from fx_future c, train t, s where c.p3 is not null),
near as (select row, col, d, k, row_number() over (partition by row, col order by d) as nth from dist),
done as (select row, col, avg(d) as mop from near where nth <= k group by row, col)
select c.row, c.col, {r('mop')} from fx_future c left join done x on x.row = c.row and x.col = c.col""")
ORACLES["mop_blocked"] = ORACLES["mop"]


@query
def mop_work(d):
    """How many pairs of a cell and a record there are, and that for the nearest hundredth under a tenth of them is computed."""
    train = _train(d)
    scored = attach(tr.mop(d.future, train, P3, percentile=1.0, broadcast_values=0, distances=True).agg(
        F.count("mop").alias("cells"), F.sum("distances").alias("computed")), train.dropna(subset=list(P3)).agg(F.count(F.lit(1)).alias("records")), ())
    pairs = F.col("cells") * F.col("records")
    return scored.select(pairs.alias("pairs"), (F.col("computed") * 10 < pairs).alias("below_tenth"))


oracle("mop_work", f"""with {_TRAIN} select (select count(*) from fx_future where p1 is not null and p2 is not null and p3 is not null)
  * (select count(*) from train) as pairs, true as below_tenth""")


@query
def mop_by_zone(d):
    return tidy(tr.mop(*_zone(d), P3, keys=["zone"]))


@query
def mop_by_zone_blocked(d):
    return tidy(tr.mop(*_zone(d), P3, broadcast_values=0, keys=["zone"]))


for _name in ("mop_by_zone", "mop_by_zone_blocked"):
    oracle(_name, f"""with {_TRAIN}, th as (select *, case when col * 3 < {{G}} then 0 when col * 3 < {{G}} * 2 then null else 4 end as zone from train),
future as (select *, case when col * 3 < {{G}} then 0 when col * 3 < {{G}} * 2 then null else 3 end as zone from fx_future),
s as (select zone, avg(p1) as m1, case when stddev_pop(p1) < 1e-12 then 1 else stddev_pop(p1) end as s1, avg(p2) as m2,
  case when stddev_pop(p2) < 1e-12 then 1 else stddev_pop(p2) end as s2, avg(p3) as m3, case when stddev_pop(p3) < 1e-12 then 1 else stddev_pop(p3) end as s3,
  greatest(1, round_even(count(*) * 0.1e0, 0)) as k from th group by zone),
dist as (select c.row, c.col, sqrt(((c.p1 - t.p1) / s1) ** 2 + ((c.p2 - t.p2) / s2) ** 2 + ((c.p3 - t.p3) / s3) ** 2) as d, k
  from future c join th t on t.zone is not distinct from c.zone join s on s.zone is not distinct from c.zone where c.p3 is not null),
near as (select row, col, d, k, row_number() over (partition by row, col order by d) as nth from dist),
done as (select row, col, avg(d) as mop from near where nth <= k group by row, col)
select c.zone, c.row, c.col, {r('mop')} from future c left join done x on x.row = c.row and x.col = c.col""")


@query
def extrapolation_share(d):
    return tidy(tr.extrapolation_share(tr.mess(d.future, _train(d), P3)))


oracle("extrapolation_share", f"""with {_MESS} select {r('avg(cast(mess < 0 as int))', 'extrapolated_share')},
  {r('coalesce(max(abs(mess)), 1e0)', 'display_limit')} from mess""")


# --- regridding ----------------------------------------------------------------------------

def _to_coarse(d, method):
    """Fine layers onto a grid of 2.5-cell squares shifted against the source."""
    target = Grid(0.5, float(d.side), 2.5, 2.5, int(d.side // 2.5), int(d.side // 2.5), "EPSG:32633")
    return tidy(regrid(d.layer_values, d.layers, target, method))


def _to_fine(d, method):
    """The coarse layer onto a fine grid with three rows and columns more to the north and west than it covers."""
    side = int(d.side) + 3
    return tidy(regrid(d.coarse, [d.coarse_layer], Grid(-3.0, d.side + 3.0, 1.0, 1.0, side, side, "EPSG:32633"), method))


for _method, _move in (("nearest", _to_fine), ("bilinear", _to_fine), ("cubic", _to_fine), ("average", _to_coarse),
                       ("mode", _to_coarse), ("median", _to_coarse)):
    QUERIES[f"regrid_{_method}"] = (lambda m, f: lambda spark, sf_dir: f(Data(spark, sf_dir), m))(_method, _move)


@query
def regrid_minmax(d):
    return tidy(_to_coarse(d, {"p1": "min", "p2": "max"}))


_FINE = """n as (select g + 3 as g from fx_size), t as (select cast(i // g as int) as row, cast(i % g as int) as col from
  (select unnest(range(0, (select g * g from n))) as i), n),
pos as (select row, col, (col + 0.5e0 - 3 - 0.5e0) / 2 as u, (row + 0.5e0 - 3) / 2 as v from t),
ends as (select max(row) + 1 as h, max(col) + 1 as w from fx_coarse)"""
oracle("regrid_nearest", f"""with {_FINE} select 'soil' as layer, p.row, p.col, {r('value')} from pos p
left join fx_coarse s on s.row = floor(v) and s.col = floor(u)""")


def _kernel(reach: str, weight: str) -> str:
    return f"""with {_FINE}, o as (select unnest([{reach}]) as o),
near as (select row, col, floor(u - 0.5e0) + a.o as c, floor(v - 0.5e0) + b.o as r, u - 0.5e0 as u, v - 0.5e0 as v,
  u >= 0 and u < w and v >= 0 and v < h as inside from pos, ends, o a, o b),
met as (select n.row, n.col, case when inside then value end as value, {weight.format(d='abs(u - c)')} * {weight.format(d='abs(v - r)')} as w from near n
  left join fx_coarse s on s.row = n.r and s.col = n.c)
select 'soil' as layer, row, col, {r('case when abs(sum(w) filter (value is not null)) > 1e-9 then sum(w * value) / sum(w) filter (value is not null) end', 'value')}
from met group by row, col"""


oracle("regrid_bilinear", _kernel("0, 1", "(1 - {d})"))
oracle("regrid_cubic", _kernel("-1, 0, 1, 2", """(case when {d} <= 1 then 1.5e0 * {d} ** 3 - 2.5e0 * {d} ** 2 + 1
  when {d} < 2 then -0.5e0 * {d} ** 3 + 2.5e0 * {d} ** 2 - 4 * {d} + 2 else 0 end)"""))

_COARSE = """n as (select cast(floor(g / 2.5e0) as int) as n from fx_size),
t as (select layer, cast(i // n as int) as row, cast(i % n as int) as col from (select unnest(range(0, (select n * n from n))) as i), n,
  (values ('p1'), ('p2')) l(layer)),
src as (select layer, row, col, value from fx_layer_values where not (layer = 'p1' and value = -9999)),
met as (select t.layer, t.row, t.col, value,
  (least(s.col + 1, 0.5e0 + (t.col + 1) * 2.5e0) - greatest(s.col, 0.5e0 + t.col * 2.5e0))
  * (least(s.row + 1, (t.row + 1) * 2.5e0) - greatest(s.row, t.row * 2.5e0)) as w
  from t left join src s on s.layer = t.layer and s.col < 0.5e0 + (t.col + 1) * 2.5e0 and s.col + 1 > 0.5e0 + t.col * 2.5e0
    and s.row < (t.row + 1) * 2.5e0 and s.row + 1 > t.row * 2.5e0)"""


def _pooled(expr: str) -> str:
    return f"with {_COARSE} select layer, row, col, {r(expr, 'value')} from met group by layer, row, col"


oracle("regrid_average", _pooled("sum(value * w) / sum(w) filter (value is not null)"))
oracle("regrid_median", _pooled("quantile_cont(value, 0.5e0)"))
oracle("regrid_minmax", _pooled("case when layer = 'p1' then min(value) else max(value) end"))
oracle("regrid_mode", f"""with {_COARSE}, c as (select layer, row, col, value, count(*) as n from met where value is not null group by layer, row, col, value),
best as (select *, row_number() over (partition by layer, row, col order by n desc, value) as k from c)
select t.layer, t.row, t.col, {r('value')} from t left join best b on b.layer = t.layer and b.row = t.row and b.col = t.col and k = 1""")


# --- notes and the whole run ---------------------------------------------------------------

def _run_summary(d):
    """Per-species summaries; every second species also has an ensemble row."""
    summary = ev.summarise_metrics(d.metrics, ["species"])
    joint = ev.summarise_metrics(d.metrics.where("species % 2 = 0").withColumn("algorithm", F.lit("Ensemble")), ["species"])
    return summary.unionByName(joint)


@query
def run_headline(d):
    return tidy(headline(_run_summary(d), ["species"]))


@query
def run_notes_(d):
    return run_notes(_run_summary(d), d.runs, ["species"]).select("species", "heading", "tone")


_HEAD = """metrics as (select * from fx_metrics union all
  select species, 'Ensemble' as algorithm, replicate, auc, tss, boyce, threshold from fx_metrics where species % 2 = 0),
summary as (select species, algorithm, avg(auc) as auc_mean, stddev_pop(auc) as auc_sd, avg(tss) as tss_mean,
  stddev_pop(tss) as tss_sd, avg(boyce) as boyce_mean, stddev_pop(boyce) as boyce_sd from metrics group by species, algorithm),
low as (select species, min(tss_mean) as tss_low, max(tss_mean) as tss_high, count(tss_mean) as n_tss from summary
  where algorithm <> 'Ensemble' group by species),
pick as (select *, row_number() over (partition by species order by algorithm = 'Ensemble' desc, tss_mean desc nulls last) as k from summary),
head as (select p.species, p.algorithm, auc_mean, tss_mean, boyce_mean, auc_sd, tss_sd, boyce_sd, tss_low, tss_high, n_tss
  from pick p join low on low.species = p.species where k = 1)"""
oracle("run_headline", f"with {_HEAD} select species, algorithm, " + ", ".join(
    r(c) for c in ("auc_mean", "tss_mean", "boyce_mean", "auc_sd", "tss_sd", "boyce_sd", "tss_low", "tss_high")) + ", n_tss from head")
_RULES = [
    ("true", "Overall performance", "case when tss_mean >= 0.6 then 'good' when tss_mean >= 0.4 then 'ok' else 'caution' end"),
    ("auc_mean >= 0.7 and boyce_mean < 0.5", "A mixed signal", "'caution'"),
    ("gap >= 0.15", "Overfitting", "'caution'"), ("gap >= 0.08 and gap < 0.15", "Some overfitting", "'info'"),
    ("gap < 0.05 and cv_auc >= 0.7", "Generalization", "'good'"),
    ("worst is not null", "Run-to-run stability", "case when worst > 0.1 then 'caution' when worst <= 0.05 then 'good' else 'ok' end"),
    ("true", "Agreement between algorithms",
     "case when disagreement_share * 100 < 10 then 'good' when disagreement_share * 100 >= 25 then 'caution' else 'info' end"),
    ("true", "Predicted suitable area", "'info'"),
    ("extrapolated_share is not null", "Extrapolation in the projection", "case when extrapolated_share * 100 >= 20 then 'caution' else 'info' end"),
    ("true", "How performance was tested", "case when split_method = 'spatial_block' then 'good' else 'ok' end"),
    ("true", "Sample size", "case when n_presence < 50 then 'caution' when n_presence < 100 then 'ok' else 'info' end"),
    ("n_dropped > 0", "Dropped predictors", "'info'"), ("presence_only", "What the scores mean here", "'info'"),
    ("removed >= 0.1", "Records removed in cleaning", "case when removed >= 0.3 then 'caution' else 'info' end"),
]
oracle("run_notes", f"""with {_HEAD}, x as (select h.*, r.* exclude (species), train_auc - cv_auc as gap,
  greatest(auc_sd, tss_sd, boyce_sd) as worst from head h join fx_runs r on r.species = h.species)
""" + " union all ".join(f"select species, '{h}' as heading, {t} as tone from x where {c}" for c, h, t in _RULES))


def _settings() -> Settings:
    return Settings(background="ratio", ratio=1.0, k=3, block_shape="square", algorithms=("enfa", "lr"), replicates=2,
                    params={})


def _inputs(d):
    """Occurrences and cells, derived once instead of once per stage of the run."""
    return checkpointed(d.occ.drop("species")), checkpointed(d.cells), d.grid


@query
def habitat_run(d):
    """Flagship: occurrences and cells to the ensemble suitability surface with uncertainty."""
    return tidy(run(*_inputs(d), _settings()).surface)


def _explained(d):
    return run(*_inputs(d), _settings())


@query
def run_importance(d):
    """Importance summary of every algorithm of a whole run."""
    return tidy(_explained(d).importance_summary)


@query
def run_curves(d):
    """The ensemble's response curves of a whole run."""
    return tidy(_explained(d).ensemble_curves)


@query
def run_binaries(d):
    """Per-algorithm and ensemble binary surfaces of a whole run."""
    return _explained(d).surface.select("row", "col", "enfa_binary", "lr_binary", "binary")


@query
def run_tables(d):
    """All report tables of a whole run, written to storage and read back: rows of each."""
    done, folder, out = _explained(d), fresh_path(d.spark, "tables"), None
    done.write_tables(folder)
    for name in done.tables():
        one = d.spark.read.json(f"{folder}/{name}").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def habitat_run_notes(d):
    """The same run carried to a second grid, read by the rules."""
    return run(*_inputs(d), _settings(), projection_cells=d.future).notes
