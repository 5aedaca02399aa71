"""Queries over labelled records: selection, splits, fits, evaluation and explanation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.scalars import complete_rows
from ..models import fit, fit_by, mlp, register
from ..models.base import Model, in_batches, summary_of, training_rows
from ..models.gam import ORDER, RIDGE, _weights
from ..models.maxent import feature_classes_column
from ..models.registry import load_model, save_model
from ..operators import ensemble as ens
from ..operators import evaluate as ev
from ..operators import explain as ex
from ..operators import select as se
from ..operators import splits as sp
from ..operators.common import checkpointed, groups_of, join_on
from ..plans.crossval import cross_validate
from .points import LABELLED, PREDICTORS, fresh_path, labelled
from .tables import Data, r, tidy, uniform, with_tables

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__.rstrip("_")] = lambda spark, sf_dir: fn(Data(spark, sf_dir))
    return fn


def oracle(name: str, sql: str):
    ORACLES[name] = with_tables(sql)


# --- predictor selection -------------------------------------------------------------------

def _finite_vif(df):
    return df.withColumn("vif", F.when(F.col("vif") != float("inf"), F.col("vif")))


@query
def vif_once(d):
    return tidy(se.vif(d.matrix, ["a", "b", "c"]), 3)


@query
def vif_by_key(d):
    return tidy(se.vif(d.matrix.withColumn("part", F.col("pid") % 7), ["a", "b", "c"], ["part"]), 3)


# Three predictors: VIF = cofactor of the correlation matrix over its determinant.
_CORR = """c as (select {key}corr(a, b) as ab, corr(a, c) as ac, corr(b, c) as bc from fx_matrix{group}),
v as (select *, 1 + 2*ab*ac*bc - ab*ab - ac*ac - bc*bc as det from c)"""
_THREE = " union all ".join(
    f"select {{key}}'{n}' as feature, {r(f'(1 - {o} * {o}) / det', 'vif', 3)} from v" for n, o in (("a", "bc"), ("b", "ac"), ("c", "ab")))
oracle("vif_once", f"with {_CORR.format(key='', group='')} {_THREE.format(key='')}")
oracle("vif_by_key", f"with {_CORR.format(key='pid % 7 as part, ', group=' group by pid % 7')} {_THREE.format(key='part, ')}")


@query
def vif_steps(d):
    return tidy(_finite_vif(se.vif_steps(d.matrix, ["a", "b", "c", "konst"])), 3)


@query
def vif_stepwise(d):
    steps = se.vif_steps(d.matrix, ["a", "b", "c", "konst"])
    return se.retained(steps, ["a", "b", "c", "konst"])


_STEPS = f"""with {_CORR.format(key='', group='')},
w as (select (1 - bc*bc) / det as va, (1 - ac*ac) / det as vb, (1 - ab*ab) / det as vc, ab, ac, bc from v),
z as (select *, case when greatest(va, vb, vc) <= 10 then '' when va >= vb and va >= vc then 'a'
  when vb >= vc then 'b' else 'c' end as gone from w),
y as (select *, case gone when 'a' then 1 / (1 - bc*bc) when 'b' then 1 / (1 - ac*ac) else 1 / (1 - ab*ab) end as pair from z),
steps as (select 0 as step, 'konst' as feature, cast(null as double) as vif, true as dropped from y
  union all select 0, 'a', va, false from y union all select 0, 'b', vb, false from y union all select 0, 'c', vc, false from y
  union all select 1, 'a', va, gone = 'a' from y union all select 1, 'b', vb, gone = 'b' from y
  union all select 1, 'c', vc, gone = 'c' from y
  union all select 2, f, pair, pair > 10 and f = (case when gone = 'a' then 'b' else 'a' end) from y, (values ('a'), ('b'), ('c')) t(f)
    where gone <> '' and f <> gone)"""
oracle("vif_steps", f"{_STEPS} select step, feature, {r('vif', digits=3)}, dropped from steps")
oracle("vif_stepwise", f"""{_STEPS} select feature, cast(case feature when 'a' then 0 when 'b' then 1 when 'c' then 2 else 3 end as int)
  as position from steps group by feature having not bool_or(dropped)""")


# --- splits --------------------------------------------------------------------------------

def _order(by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    return f"""select *, row_number() over ({part}order by md5('42:' || pid), pid) - 1 as o,
  count(*) over ({part.strip()}) as n from fx_matrix"""


@query
def split_holdout(d):
    return sp.split_holdout(d.matrix, "pid", "label").select("pid", "label", "is_test")


@query
def split_holdout_plain(d):
    return sp.split_holdout(d.matrix, "pid").select("pid", "is_test")


oracle("split_holdout", f"select pid, label, o < round_even(n * 0.25e0, 0) as is_test from ({_order('label')}) t")
oracle("split_holdout_plain", f"select pid, o < greatest(1, round_even(n * 0.25e0, 0)) as is_test from ({_order()}) t")

_FOLD = """cast(case when o < (n % 5) * (n // 5 + 1) then o // (n // 5 + 1)
  else n % 5 + (o - (n % 5) * (n // 5 + 1)) // (n // 5) end as int) as fold"""


@query
def split_kfold(d):
    return sp.split_kfold(d.matrix, "pid", "label").select("pid", "label", "fold")


@query
def split_kfold_plain(d):
    return sp.split_kfold(d.matrix, "pid").select("pid", "fold")


oracle("split_kfold", f"select pid, label, {_FOLD} from ({_order('label')}) t")
oracle("split_kfold_plain", f"select pid, {_FOLD} from ({_order()}) t")


@query
def fold_summary(d):
    return sp.fold_summary(sp.split_kfold(d.matrix, "pid", "label"))


oracle("fold_summary", f"""with s as (select pid, label, {_FOLD} from ({_order('label')}) t),
f as (select fold, count(*) as n_test, count(*) filter (label = 1) as presences_test from s group by fold),
w as (select count(*) as n, count(*) filter (label = 1) as p from s)
select fold, n - n_test as n_train, n_test, p - presences_test as presences_train, presences_test from f, w""")

SIZE = 3.0


def _inside(d):
    return d.occ.where("x is not null").select("rid", "x", "y", F.col("presence").alias("label"))


@query
def blocks_square(d):
    return tidy(sp.blocks_square(_inside(d), d.grid, SIZE).select("rid", "block_id", "block_x", "block_y"))


_SQUARE = f"""n as (select greatest(1, cast(ceil(g / {SIZE}e0) as int)) as n from fx_size),
placed as (select rid, presence as label, cast(least(n - 1, greatest(0, floor(x / {SIZE}e0))) as bigint) as cx,
  cast(least(n - 1, greatest(0, floor(y / {SIZE}e0))) as bigint) as cy, n from fx_occ, n where x is not null),
blocked as (select rid, label, cy * n + cx as block_id, (cx + 0.5e0) * {SIZE}e0 as block_x, (cy + 0.5e0) * {SIZE}e0 as block_y from placed)"""
oracle("blocks_square", f"with {_SQUARE} select rid, block_id, {r('block_x')}, {r('block_y')} from blocked")


@query
def blocks_hex(d):
    return tidy(sp.blocks_hex(_inside(d), SIZE).select("rid", "block_id", "block_x", "block_y"))


_HEX = f"""h as (select {SIZE}e0 / sqrt(1.5e0 * sqrt(3e0)) as s),
q as (select rid, presence as label, x * (2e0/3e0) / s as q, (y * (sqrt(3e0)/3e0) - x * (1e0/3e0)) / s as r, s from fx_occ, h where x is not null),
c as (select *, -q - r as t, round_even(q, 0) as rq, round_even(r, 0) as rr, round_even(-q - r, 0) as rt from q),
k as (select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rt - t) as dt from c),
a as (select rid, label, s, cast(case when dq > dt and dq > dr then -rt - rr else rq end as bigint) as hq,
  cast(case when dq > dt and dq > dr then rr when dt > dr then rr else -rq - rt end as bigint) as hr from k),
blocked as (select rid, label, dense_rank() over (order by hq, hr) - 1 as block_id, hq * (1.5e0 * s) as block_x,
  (hq * (sqrt(3e0)/2) + hr * sqrt(3e0)) * s as block_y from a)"""
oracle("blocks_hex", f"with {_HEX} select rid, block_id, {r('block_x')}, {r('block_y')} from blocked")


@query
def block_folds(d):
    return tidy(sp.block_folds(sp.blocks_square(_inside(d), d.grid, SIZE)))


_DEALT = """b as (select block_id, count(*) as n_points, min(block_x) as block_x, min(block_y) as block_y from blocked group by block_id),
f as (select *, cast((row_number() over (order by md5('42:' || block_id), block_id) - 1) % 5 as int) as fold from b)"""
oracle("block_folds", f"with {_SQUARE}, {_DEALT} select block_id, n_points, {r('block_x')}, {r('block_y')}, fold from f")


@query
def split_blocks(d):
    return sp.split_blocks(_inside(d), d.cells, d.grid, block_size=SIZE, shape="hexagon").select("rid", "block_id", "fold")


oracle("split_blocks", f"with {_HEX}, {_DEALT} select rid, p.block_id, fold from blocked p join f on f.block_id = p.block_id")


@query
def block_corners(d):
    folds = sp.block_folds(sp.blocks_hex(_inside(d), SIZE))
    corners = sp.block_corners(folds, SIZE, "hexagon").select("block_id", F.posexplode("corners").alias("corner", "p"))
    return tidy(corners.select("block_id", "corner", "p.x", "p.y"))


oracle("block_corners", f"""with {_HEX}, {_DEALT} select block_id, cast(i as int) as corner,
  {r('block_x + s * cos(radians(60 * i))', 'x')}, {r('block_y + s * sin(radians(60 * i))', 'y')}
from f, h, (select unnest(range(0, 6)) as i) t""")


@query
def variogram(d):
    return tidy(sp.variogram(d.cells, d.grid, "p1"), 5)


@query
def auto_block_size(d):
    return tidy(sp.auto_block_size(d.cells, d.grid, "p1"), 5)


_U = [uniform(f"'42:{a}:' || {v} || ':{b}'") for a, v, b in
      (("variogram", "i", "x"), ("variogram", "i", "y"), ("pair", "p", "a"), ("pair", "p", "b"))]
_VARIOGRAM = f"""ids as (select unnest(range(0, 2000)) as i),
drawn as (select i, {_U[0]} * {{G}} as x, {_U[1]} * {{G}} as y from ids),
sample as (select row_number() over (order by i) - 1 as k, d.x, d.y, p1 as v from drawn d
  join fx_cells c on c.row = floor({{G}} - d.y) and c.col = floor(d.x) where p1 is not null),
size as (select count(*) as n from sample),
pairs as (select floor({_U[2]} * n) as ka, floor({_U[3]} * n) as kb from (select unnest(range(0, 20000)) as p) t, size),
dist as (select sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, (a.v - b.v) * (a.v - b.v) / 2 as g
  from pairs join sample a on a.k = ka join sample b on b.k = kb where ka <> kb),
span as (select quantile_cont(d, 0.9e0) as m from dist),
bins as (select cast(floor(d / (m / 20)) as int) as bin, count(*) as n_pairs, avg(g) as gamma from dist, span
  where d < m group by 1 having count(*) > 20)"""
oracle("variogram", f"""with {_VARIOGRAM} select bin, n_pairs, {r('gamma', digits=5)}, {r('(bin + 0.5e0) * (m / 20)', 'distance', 5)},
  n as n_valid from bins, span, size""")
oracle("auto_block_size", f"""with {_VARIOGRAM}, sill as (select quantile_cont(gamma, 0.95e0) as s, count(*) as nb from bins),
hit as (select min((bin + 0.5e0) * (m / 20)) as d from bins, span, sill where gamma >= s * 0.9e0),
ok as (select n >= 200 and nb >= 5 and s > 0 as ok from size, sill)
select {r('case when ok then least({G} / 3e0, greatest({G} / 80e0, d)) else {G} / 20e0 end', 'block_size', 5)},
  case when ok then 'auto_variogram' else 'auto_fallback' end as source from hit, ok""")


# --- fits ----------------------------------------------------------------------------------

FEATURES = ["a", "b", "d", "e"]
# Reduced sizes for the checks; the models' own defaults stay available as parameters. lr, gam, mlp and maxent run at theirs.
QUICK = {"rf": {"n_estimators": 20, "max_depth": 8}, "gbm": {"n_estimators": 12, "learning_rate": 0.1},
         "xgb": {"n_estimators": 10, "max_depth": 4}, "svm": {"landmarks": 32, "folds": 2, "max_iter": 20}}


def _records(d, name):
    """The labelled records; tree fits read them several times, so they are derived once for the fit and the scores."""
    return checkpointed(d.matrix.select("pid", "label", *FEATURES)) if name in ("rf", "gbm", "xgb") else d.matrix


def _fit(d, name):
    rows = _records(d, name)
    m = fit(name, rows, FEATURES, **QUICK.get(name, {}))
    return tidy(m.score(rows).select("pid", "label", "score"))


for _name in ("lr", "gam", "rf", "gbm", "xgb", "svm", "mlp", "maxent"):
    QUERIES[f"fit_{_name}"] = (lambda n: lambda spark, sf_dir: _fit(Data(spark, sf_dir), n))(_name)


def _checked(d, name):
    """What must hold for any sound fit, per label: a score for each complete row, within [0, 1], and some skill."""
    rows = _records(d, name)
    scored = checkpointed(fit(name, rows, FEATURES, **QUICK.get(name, {})).score(rows).select("label", "score"))
    skilled = ev.auc(scored.where("score is not null"), "label", "score").first().auc >= AUC_FLOOR
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").isNull()).alias("n_null"),
        (F.count_if(~F.col("score").between(0.0, 1.0)) == 0).alias("in_range")).withColumn("skilled", F.lit(skilled))


#: Separation that each algorithm must reach on its own training rows.
AUC_FLOOR = 0.55
for _name in ("lr", "gam", "rf", "gbm", "xgb", "svm", "mlp", "maxent"):
    QUERIES[f"fit_{_name}_checked"] = (lambda n: lambda spark, sf_dir: _checked(Data(spark, sf_dir), n))(_name)
    oracle(f"fit_{_name}_checked", f"""select label, count(*) as n, count(*) filter (where {' or '.join(f'{c} is null' for c in FEATURES)}) as n_null,
      true as in_range, true as skilled from fx_matrix group by label""")


@query
def fit_lr_residuals(d):
    """The logistic fit's own score equations, one per term: zero at the optimum."""
    m = fit("lr", d.matrix, FEATURES)
    rows = m.score(complete_rows(d.matrix, FEATURES))
    st = m.state
    z = [(F.col(p) - mu) / sd for p, mu, sd in zip(FEATURES, st["mean"], st["sd"])]
    terms = {"intercept": F.lit(1.0), **dict(zip(FEATURES, z)), **{f"{p}^2": c * c for p, c in zip(FEATURES, z)}}
    weight = [0.0, *st["coef"]]
    gap = F.col("score") - F.col("label")
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(gap * t).alias(f"g{i}") for i, t in enumerate(terms.values())])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), ((F.col(f"g{i}") + w / m.params["C"]) / F.col("n")).alias("residual"))
                               for i, (t, w) in enumerate(zip(terms, weight))]))
    return tidy(got.select(each.alias("e")).select("e.*"), 3)


oracle("fit_lr_residuals", "select unnest(['intercept', " + ", ".join(f"'{f}', '{f}^2'" for f in FEATURES) + "]) as term, 0e0 as residual")


@query
def fit_mlp_gradient(d):
    """The gradient of the perceptron's penalised loss, per row, for every weight: zero at the optimum."""
    m = fit("mlp", d.matrix, FEATURES)
    st, p, hidden = m.state, len(FEATURES), m.params["hidden"]
    theta, rows = np.array(st["theta"]), m.score(complete_rows(d.matrix, FEATURES))
    pull = m.params["alpha"] * mlp.decayed(p, hidden) * theta
    z = [(F.col(c) - mu) / sd for c, mu, sd in zip(FEATURES, st["mean"], st["sd"])]
    rows = rows.select("label", "score", *[c.alias(f"z{i}") for i, c in enumerate(z)], *[u.alias(f"h{k}") for k, u in enumerate(mlp.hidden_units(m))])
    gap, out = F.col("score") - F.col("label"), theta[p * hidden + hidden:-1]
    back = [gap * float(out[k]) * (F.col(f"h{k}") > 0).cast("int") for k in range(hidden)]
    sums = [F.sum(back[k] * F.col(f"z{i}")) for i in range(p) for k in range(hidden)] + [F.sum(b) for b in back] + [F.sum(gap * F.col(f"h{k}")) for k in range(hidden)] + [F.sum(gap)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("g"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("weight"), ((F.col("g")[i] + float(v)) / F.col("n")).alias("gradient")) for i, v in enumerate(pull)]))
    return tidy(got.select(each.alias("e")).select("e.*"), 3)


oracle("fit_mlp_gradient", f"select cast(unnest(range(0, {len(FEATURES) * 8 + 17})) as int) as weight, 0e0 as gradient")


def enfa_sql(train: str, target: str, keep: str, x1: str, x2: str, by: str = "", link: str = "") -> str:
    """Niche factor scores in closed form for two predictors, optionally one fit per ``by`` value.

    Common table expressions ending in ``scored(keep, score)``.
    """
    g, gs = (f"{by}, ", f" group by {by}") if by else ("", "")
    on = f"t.{by} = m.{by}" if by else "true"
    return f"""m as materialized (select {g}avg({x1}) as m1, stddev_pop({x1}) as s1, avg({x2}) as m2, stddev_pop({x2}) as s2 from {train}{gs}),
z as materialized (select {'t.' + by + ', ' if by else ''}({x1} - m1) / s1 as z1, ({x2} - m2) / s2 as z2 from {train} t join m on {on} where label = 1),
cv as materialized (select {g}avg(z1) as c1, avg(z2) as c2, covar_samp(z1, z1) + 1e-6 as v11, covar_samp(z2, z2) + 1e-6 as v22,
  covar_samp(z1, z2) as v12 from z{gs}),
inv as materialized (select *, v22 / (v11*v22 - v12*v12) as i11, v11 / (v11*v22 - v12*v12) as i22, -v12 / (v11*v22 - v12*v12) as i12 from cv),
dist as materialized (select {'t.' + by + ', ' if by else ''}sqrt(greatest(0, (z1-c1)*(z1-c1)*i11 + 2*(z1-c1)*(z2-c2)*i12 + (z2-c2)*(z2-c2)*i22)) as d
  from z t join inv m on {on}),
sc as materialized (select {g}quantile_cont(d, 0.95e0) as q from dist{gs}),
tz as materialized (select t.*, ({x1} - m1) / s1 as z1, ({x2} - m2) / s2 as z2 from {target} t join m on {link or on}),
scored as (select {keep}, case when z1 is not null and z2 is not null then exp(-sqrt(greatest(0, (z1-c1)*(z1-c1)*i11 + 2*(z1-c1)*(z2-c2)*i12 + (z2-c2)*(z2-c2)*i22))
  / case when q > 0 then q else 1 end) end as score from tz t join inv m on {link or on} join sc{' on sc.' + by + ' = t.' + by if by else ' on true'})"""


# --- fits of many species in one job --------------------------------------------------------

SPECIES = "case when pid % 7 = 6 then null else pid % 7 end"


def _by_species(d):
    return d.matrix.withColumn("species", F.expr(SPECIES))


@query
def fit_lr_by_species(d):
    """The score equations of every species' logistic fit: zero at the optimum."""
    df = _by_species(d)
    m = fit_by("lr", df, FEATURES, ["species"])
    rows = join_on(m.score(complete_rows(df, FEATURES)), m.state, m.keys, small=True)
    z = [(F.col(p) - F.col("mean")[i]) / F.col("sd")[i] for i, p in enumerate(FEATURES)]
    terms = [F.lit(1.0), *z, *[c * c for c in z]]
    names = ["intercept", *FEATURES, *[f"{p}^2" for p in FEATURES]]
    gap = F.col("score") - F.col("label")
    got = rows.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.first("beta").alias("beta"), F.array(*[F.sum(gap * t) for t in terms]).alias("g"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), ((F.col("g")[i] + (F.col("beta")[i] / m.params["C"] if i else 0.0)) / F.col("n")).alias("residual"))
                               for i, t in enumerate(names)]))
    return tidy(got.select("species", "n", each.alias("e")).select("species", "n", "e.*"))


_TERMS = ", ".join(f"'{t}'" for t in ["intercept", *FEATURES, *[f"{f}^2" for f in FEATURES]])
oracle("fit_lr_by_species", f"""select species, n, unnest([{_TERMS}]) as term, 0e0 as residual
from (select {SPECIES} as species, count(*) as n from fx_matrix group by 1) t""")


@query
def fit_gam_by_species(d):
    """The penalised score equations of every species' splines, one for each piece: zero at the optimum."""
    df = checkpointed(_by_species(d).select("species", "label", *FEATURES))  # derived once for the fit and its check
    m = fit_by("gam", df, FEATURES, ["species"])
    n, penalty = m.params["n_splines"], m.params["penalty"]
    spans = {r["species"]: (r["lows"], r["steps"]) for r in m.state.select("species", "lows", "steps").collect()}  # 7 species
    rows = m.score(complete_rows(df, FEATURES)).select("species", *FEATURES, (F.col("score") - F.col("label")).alias("gap"))

    def weigh(batches):
        """Sums of a task: gap times weight of every piece, per species. Written out as columns they outgrow a compiled method."""
        totals = {}
        for pdf in batches:
            x, gap = pdf[FEATURES].to_numpy(float), pdf["gap"].to_numpy(float)
            for (species,), at in groups_of(pdf, ["species"]):
                for i, (low, step) in enumerate(zip(*spans[species])):
                    t = (x[at, i] - low) / step
                    j = np.clip(np.floor(t), 0, n - ORDER - 1).astype(int)
                    add = totals.setdefault((species, FEATURES[i]), np.zeros(n))
                    for k, w in enumerate(_weights(t - j)):
                        add += np.bincount(j + k, gap[at] * w, n)
        yield pd.DataFrame([(*key, k, v) for key, sums in totals.items() for k, v in enumerate(sums)], columns=["species", "predictor", "piece", "g"])

    sums = rows.mapInPandas(weigh, "species bigint, predictor string, piece int, g double").groupBy("species", "predictor", "piece").agg(F.sum("g").alias("g"))

    def pull(i):
        """What the penalty adds to the gradient of the ``i``-th predictor's pieces."""
        c = F.slice("beta", 2 + i * n, n)
        bent = F.transform(F.sequence(F.lit(0), F.lit(n - 3)), lambda k: F.get(c, k) - 2 * F.get(c, k + 1) + F.get(c, k + 2))
        at = lambda k: F.coalesce(F.get(bent, k), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: penalty * (at(k) - 2 * at(k - 1) + at(k - 2)) + RIDGE * F.get(c, k))

    bends = [F.struct(F.lit(p).alias("predictor"), pull(i).alias("pull")) for i, p in enumerate(FEATURES)]
    pulls = m.state.select("species", "n", F.explode(F.array(*bends)).alias("e")).select("species", "n", "e.predictor", F.posexplode("e.pull").alias("piece", "pull"))
    both = join_on(pulls, sums, ["species", "predictor", "piece"], "left")
    return tidy(both.select("species", "predictor", F.col("piece").cast("int").alias("piece"), ((F.col("pull") + F.coalesce("g", F.lit(0.0))) / F.col("n")).alias("residual")))


oracle("fit_gam_by_species", f"""select species, predictor, cast(piece as int) as piece, 0e0 as residual from (select distinct {SPECIES} as species from fx_matrix) t,
(select unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) as predictor) p, (select unnest(range(0, 10)) as piece) i""")


@query
def fit_enfa_by_species(d):
    df = _by_species(d)
    return tidy(fit_by("enfa", df, ["a", "b"], ["species"]).score(df).select("pid", "label", "species", "score"))


oracle("fit_enfa_by_species", f"""with base as (select *, coalesce({SPECIES}, -1) as sp from fx_matrix), {enfa_sql('base', 'base', 't.pid, t.label, t.sp', 'a', 'b', 'sp', 't.sp = m.sp')}
select pid, label, nullif(sp, -1) as species, {r('score')} from scored""")


@query
def maxent_classes(d):
    counts = d.occ.where("presence = 1 and x is not null").groupBy(F.floor("x").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("zone", "n", F.concat_ws(",", feature_classes_column(F.col("n"))).alias("classes"))


oracle("maxent_classes", """select cast(floor(x) as bigint) as zone, count(*) as n, case when count(*) < 10 then 'linear'
  when count(*) < 15 then 'linear,quadratic' when count(*) < 80 then 'linear,quadratic,hinge'
  else 'linear,quadratic,hinge,product' end as classes
from fx_occ where presence = 1 and x is not null group by floor(x)""")


@query
def fit_enfa(d):
    m = fit("enfa", d.env, ["e1", "e2"])
    return tidy(m.score(d.env).select("pid", "label", "score"))


oracle("fit_enfa", f"with {enfa_sql('fx_env', 'fx_env', 'pid, label', 'e1', 'e2')} select pid, label, {r('score')} from scored")


def fit_centres(df, predictors, label, seed, power) -> Model:
    """A user's algorithm: how much nearer a record is to the presences' centre than to that of the others."""
    rows = training_rows(df, predictors, label)
    s = summary_of(rows, predictors)
    got = {r["label"]: r["at"] for r in rows.groupBy("label").agg(F.array(*[F.avg((F.col(p) - m) / sd) for p, m, sd in zip(predictors, s["mean"], s["sd"])]).alias("at")).collect()}
    return Model("centres", predictors, {"power": power}, {"mean": s["mean"], "sd": s["sd"], "near": got[1], "far": got[0]})


def _centres(model, frame):
    st = model.state
    z = (frame.to_numpy() - st["mean"]) / st["sd"]
    near, far = (((z - np.array(st[k])) ** 2).sum(axis=1) ** (model.params["power"] / 2) for k in ("near", "far"))
    return far / np.maximum(near + far, 1e-300)


@query
def user_algorithm(d):
    """An algorithm registered from outside, fitted, saved, reloaded and scored in batches."""
    register("centres", fit_centres, in_batches(_centres), {"power": 2}, "Nearest centre")
    path = fresh_path(d.spark, "centres")
    save_model(fit("centres", d.matrix, ["a", "b"]), d.spark, path)
    return tidy(load_model(d.spark, path).score(d.matrix).select("pid", "label", "score"))


oracle("user_algorithm", f"""with s as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from fx_matrix),
z as (select pid, label, (a - ma) / sa as za, (b - mb) / sb as zb from fx_matrix, s),
c as (select avg(za) filter (label = 1) as a1, avg(zb) filter (label = 1) as b1, avg(za) filter (label = 0) as a0, avg(zb) filter (label = 0) as b0 from z),
e as (select pid, label, (za - a1) ** 2 + (zb - b1) ** 2 as near, (za - a0) ** 2 + (zb - b0) ** 2 as far from z, c)
select pid, label, {r('far / (near + far)', 'score')} from e""")


@query
def model_roundtrip(d):
    """Saved and reloaded models score like the originals (largest difference)."""
    out, rows = None, checkpointed(d.matrix.select("label", *FEATURES))  # derived once for all fits and scores
    for name in ("lr", "enfa", "rf"):
        m = fit(name, rows, FEATURES, **{**QUICK, "rf": {"n_estimators": 5, "max_depth": 4}}.get(name, {}))
        path = fresh_path(d.spark, name)
        save_model(m, d.spark, path)
        both = load_model(d.spark, path).score(m.score(rows, "before"), "after")
        one = both.groupBy("label").agg(F.lit(name).alias("algorithm"), F.count("after").alias("n"),
                                        F.max(F.abs(F.col("before") - F.col("after"))).alias("difference"))
        out = one if out is None else out.unionByName(one)
    return tidy(out)


oracle("model_roundtrip", """select label, algorithm, count(*) as n, 0e0 as difference
from fx_matrix, (values ('lr'), ('enfa'), ('rf')) t(algorithm) group by label, algorithm""")


def _kfold(df, seed):
    return sp.split_kfold(df, "pid", "label", 3, seed)


@query
def cv_scores(d):
    cv = cross_validate(d.matrix, ["a", "d"], ["enfa"], _kfold, replicates=2)
    return tidy(cv.oof)


_CV_FOLDS = """reps as materialized (select m.pid, m.label, m.a, m.d, unnest([0, 1]) as replicate from fx_matrix m),
seeds as materialized (select *, row_number() over (partition by replicate, label order by md5((42 + 101 * replicate) || ':' || pid), pid) - 1 as o,
  count(*) over (partition by replicate, label) as n from reps),
folded as materialized (select *, cast(case when o < (n % 3) * (n // 3 + 1) then o // (n // 3 + 1)
  else n % 3 + (o - (n % 3) * (n // 3 + 1)) // (n // 3) end as int) as fold from seeds),
train as materialized (select replicate * 3 + (fold + s) % 3 as unit, label, a, d from folded, (values (1), (2)) t(s)),
held as materialized (select *, replicate * 3 + fold as unit from folded)"""
oracle("cv_scores", f"""with {_CV_FOLDS}, {enfa_sql('train', 'held', 't.pid, t.label, t.replicate', 'a', 'd', 'unit', 't.unit = m.unit')}
select 'enfa' as algorithm, replicate, pid, label, {r('score')} from scored""")


@query
def failed_fits(d):
    """A failing unit becomes an error row while the others finish."""
    cv = cross_validate(d.matrix, ["a", "d"], ["enfa", "svm"], _kfold, replicates=1, params={"svm": {"kernel": "none"}})
    done = cv.oof.groupBy("algorithm", "replicate").agg(F.count(F.lit(1)).alias("n"))
    return done.withColumn("failed", F.lit(False)).unionByName(
        cv.errors_frame().select("algorithm", "replicate", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("failed")))


oracle("failed_fits", """select 'enfa' as algorithm, 0 as replicate, count(*) as n, false as failed from fx_matrix
union all select 'svm', 0, 0, true""")


# --- evaluation ----------------------------------------------------------------------------

BY = ["algorithm", "replicate"]


def _evaluation(source: str, keys: str) -> str:
    """Metrics of ``source(keys, label, score)`` as ``ranked`` and ``index`` per key."""
    return f"""cnt as (select {keys}, score as s, count(*) filter (label = 1) as p, count(*) filter (label <> 1) as n
  from {source} where score is not null group by {keys}, score),
tot as (select {keys}, cast(sum(p) as double) as pp, cast(sum(n) as double) as nn, min(s) as lo, max(s) as hi from cnt group by {keys}),
pre as (select *, coalesce(sum(p) over w, 0) as pb, coalesce(sum(n) over w, 0) as nb from cnt
  window w as (partition by {keys} order by s rows between unbounded preceding and 1 preceding)),
gain as (select pre.*, pp, nn, nb * pp - pb * nn as gain from pre join tot using ({keys})),
best as (select *, row_number() over (partition by {keys} order by gain desc, s desc) as k from gain),
ranked as (select {keys}, sum(p * (nb + n / 2e0)) / max(pp * nn) as auc, max(case when k = 1 then gain end) / max(pp * nn) as tss,
  max(case when k = 1 then s end) as threshold from best where pp > 0 and nn > 0 group by {keys}),
win as (select tot.*, i, (hi - lo) * 0.1e0 as w from tot, (select unnest(range(0, 10)) as i) t
  where pp >= 5 and pp + nn >= 20 and hi > lo),
ctr as (select *, case when i = 9 then hi - w / 2e0 else (lo + w / 2e0) + ((hi - w / 2e0) - (lo + w / 2e0)) / 9e0 * i end as c from win),
hit as (select {keys}, i, sum(p) as wp, sum(p + n) as wt, max(pp) as pp, max(pp + nn) as tt from ctr join cnt using ({keys})
  where s >= c - w / 2e0 and s <= c + w / 2e0 group by {keys}, i having sum(p) > 0),
pe as (select *, (wp / pp) / (wt / tt) as pe from hit),
rk as (select *, rank() over (partition by {keys} order by pe) + (count(*) over (partition by {keys}, pe) - 1) / 2e0 as rk from pe),
index as (select {keys}, case when isnan(corr(i, rk)) then null else corr(i, rk) end as boyce from rk group by {keys} having count(*) >= 4)"""


_EVAL = _evaluation("fx_oof", "algorithm, replicate")


@query
def auc(d):
    return tidy(ev.auc(d.oof, keys=BY))


@query
def auc_overall(d):
    return tidy(ev.auc(d.oof))


@query
def max_tss(d):
    return tidy(ev.max_tss(d.oof, keys=BY))


@query
def boyce(d):
    return tidy(ev.boyce(d.oof, keys=BY))


@query
def metrics_per_replicate(d):
    return tidy(ev.evaluate(d.oof, keys=BY))


oracle("auc", f"with {_EVAL} select algorithm, replicate, {r('auc')} from ranked")
oracle("auc_overall", f"""with whole as (select 1 as one, label, score from fx_oof), {_evaluation('whole', 'one')} select {r('auc')} from ranked""")
oracle("max_tss", f"with {_EVAL} select algorithm, replicate, {r('tss')}, {r('threshold')} from ranked")
oracle("boyce", f"with {_EVAL} select algorithm, replicate, {r('boyce')} from tot left join index using (algorithm, replicate)")
_METRICS = f"{r('auc')}, {r('tss')}, {r('boyce')}, {r('threshold')}"
oracle("metrics_per_replicate", f"with {_EVAL} select algorithm, replicate, {_METRICS} from ranked left join index using (algorithm, replicate)")


@query
def evaluate_overall(d):
    return tidy(ev.evaluate(d.oof))


oracle("evaluate_overall", f"""with whole as (select 1 as one, label, score from fx_oof), {_evaluation('whole', 'one')}
select {_METRICS} from ranked left join index using (one)""")


@query
def metrics_summary(d):
    return tidy(ev.summarise_metrics(d.metrics, ["species"]))


_SUMMARY = """summary as (select species, algorithm, avg(auc) as auc_mean, stddev_pop(auc) as auc_sd, avg(tss) as tss_mean,
  stddev_pop(tss) as tss_sd, avg(boyce) as boyce_mean, stddev_pop(boyce) as boyce_sd, avg(threshold) as threshold_mean,
  count(*) as n_replicates from fx_metrics group by species, algorithm)"""
oracle("metrics_summary", f"with {_SUMMARY} select species, algorithm, " + ", ".join(
    r(f"{m}_{s}") for m in ("auc", "tss", "boyce") for s in ("mean", "sd")) + f", {r('threshold_mean')}, n_replicates from summary")


@query
def metrics_export(d):
    return tidy(ev.export_metrics(ev.evaluate(d.oof, keys=BY), ens.ensemble_cv(d.oof, _equal(d))))


def _equal(d):
    return d.oof.select("algorithm").distinct().withColumn("weight", F.when(F.col("algorithm") == "lr", 0.5).otherwise(0.25))


ENSEMBLE_OOF = """share as (select replicate, algorithm, case when algorithm = 'lr' then 0.5e0 else 0.25e0 end as w
  from fx_oof group by replicate, algorithm),
ens as (select o.replicate, pid, max(label) as label,
  case when count(score) = count(*) then round(sum(score * w), 12) end as score
  from fx_oof o join share s on s.replicate = o.replicate and s.algorithm = o.algorithm group by o.replicate, pid)"""
oracle("metrics_export", f"""with single as (with {_EVAL} select algorithm, replicate, auc, tss, boyce, threshold
  from ranked left join index using (algorithm, replicate)),
{ENSEMBLE_OOF}, joint as (with {_evaluation('ens', 'replicate')} select 'Ensemble' as algorithm, replicate, auc, tss, boyce, threshold
  from ranked left join index using (replicate))
select algorithm, replicate, {_METRICS}, cast(null as varchar) as error
from (select * from single union all select * from joint) t""")


# --- explanation ---------------------------------------------------------------------------

@query
def permute_column(d):
    return tidy(ex.permute_column(d.matrix, "pid", "b"))


oracle("permute_column", f"""with base as (select pid, row_number() over (order by md5('42:' || pid), pid) as o from fx_matrix),
moved as (select b, row_number() over (order by md5('42:0:b:' || pid), pid) as o from fx_matrix)
select pid, {r('b')} from base join moved using (o)""")


def _rule(df):
    return df.withColumn("score", F.round(F.col("a") * 0.01 + F.col("b") * 0.000005 + F.col("d") * 2, 9))


@query
def importance(d):
    return tidy(ex.importance(_rule, d.matrix, "label", ["a", "b", "d"], repeats=2))


_FEATS = "(values ('a'), ('b'), ('d')) f(feature), (values (0), (1)) r(repeat)"
oracle("importance", f"""with base as (select pid, label, a, b, d, row_number() over (order by md5('42:' || pid), pid) as o from fx_matrix),
moved as (select feature, repeat, case feature when 'a' then a when 'b' then b else d end as v,
  row_number() over (partition by feature, repeat order by md5('42:' || repeat || ':' || feature || ':' || pid), pid) as o
  from fx_matrix, {_FEATS}),
swapped as (select feature, repeat, label, case when feature = 'a' then v else a end as a, case when feature = 'b' then v else b end as b,
  case when feature = 'd' then v else d end as d from base join moved using (o)
  union all select '', -1, label, a, b, d from fx_matrix),
scored as (select feature, repeat, label, round(a * 0.01e0 + b * 0.000005e0 + d * 2, 9) as score from swapped),
{_evaluation('scored', 'feature, repeat')}
select x.feature, {r('avg(y.auc - x.auc)', 'importance')} from ranked x, ranked y where y.repeat = -1 and x.repeat >= 0 group by x.feature""")


@query
def pd_grid(d):
    return tidy(ex.pd_grid(d.matrix, ["a", "b"], 50), 4)


oracle("pd_grid", f"""with q as (select quantile_cont(a, 0.025e0) as al, quantile_cont(a, 0.5e0) as am, quantile_cont(a, 0.975e0) as ah,
  quantile_cont(b, 0.025e0) as bl, quantile_cont(b, 0.5e0) as bm, quantile_cont(b, 0.975e0) as bh from fx_matrix),
g as (select q.*, feature, cast(i as int) as grid_i, case feature when 'a' then al + (ah - al) / 49e0 * i else bl + (bh - bl) / 49e0 * i end as v
  from q, (values ('a'), ('b')) f(feature), (select unnest(range(0, 50)) as i) t)
select feature, grid_i, {r('v', 'grid_v', 4)}, {r("case when feature = 'a' then v else am end", 'a', 4)},
  {r("case when feature = 'b' then v else bm end", 'b', 4)} from g""")


@query
def pd_curve(d):
    m = fit("lr", d.matrix, FEATURES, **QUICK.get("lr", {}))
    return tidy(ex.partial_dependence(m, d.matrix, FEATURES))


def two_models(d):
    """Two fitted algorithms on the labelled points, for ensemble operators."""
    rows = checkpointed(labelled(d))
    models = {("enfa", 0): fit("enfa", rows, ["p1", "p2"]), ("lr", 0): fit("lr", rows, ["p1", "p2"], **QUICK.get("lr", {}))}
    return rows, models, {"enfa": 0.6, "lr": 0.4}


@query
def ensemble_importance(d):
    rows, models, weights = two_models(d)
    return tidy(ex.ensemble_importance(models, weights, rows, "label", ["p1", "p2"], repeats=2))


@query
def train_auc(d):
    """A one-algorithm ensemble, so the closed form can follow."""
    rows = checkpointed(labelled(d))
    return tidy(ex.train_auc({("enfa", 0): fit("enfa", rows, ["p1", "p2"])}, {"enfa": 1.0}, rows, "label", ["p1", "p2"]), 4)


oracle("train_auc", f"""{LABELLED}, {enfa_sql('labelled', 'labelled', 't.label', 'p1', 'p2')},
rounded as (select 1 as one, label, round(score, 12) as score from scored), {_evaluation('rounded', 'one')} select {r('auc', digits=4)} from ranked""")


@query
def curve_bands(d):
    return tidy(ens.curve_bands(d.curves))


oracle("curve_bands", f"""select algorithm, feature, grid_i, {r('min_by(grid_v, replicate)', 'grid_v')}, {r('avg(pred)', 'mean')},
  {r('stddev_pop(pred)', 'sd')} from fx_curves group by algorithm, feature, grid_i""")


@query
def importance_summary(d):
    return tidy(ens.importance_summary(d.importance))


oracle("importance_summary", f"""with reps as (select distinct algorithm, replicate from fx_importance),
feats as (select distinct algorithm, feature from fx_importance),
full_grid as (select f.algorithm, feature, replicate from feats f join reps on reps.algorithm = f.algorithm),
v as (select g.algorithm, g.feature, coalesce(importance, 0) as i from full_grid g left join fx_importance x
  on x.algorithm = g.algorithm and x.feature = g.feature and x.replicate = g.replicate)
select algorithm, feature, {r('avg(i)', 'mean')}, {r('stddev_pop(i)', 'sd')}, count(*) as n_replicates from v group by algorithm, feature""")
