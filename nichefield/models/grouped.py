"""Fits for many keys (species) in one job: logistic terms, additive splines, niche factors.

Rows are dealt once to tasks by key, a key with very many rows to as many parts as its size asks for, and stay there. Each
round of ``lr`` and ``gam`` is one pass: every task sums, for the keys that have not settled, the penalised likelihood with
its gradient and curvature at their coefficients; the sums of a key meet in one task, which takes the Newton steps of all its
keys at once and halves a step that did not help. Keys with very many rows take their first rounds on a share of them, then
rounds over all rows until the same stop. ``enfa`` needs two aggregations by key and no round.

Only coefficients pass through the driver, those of ``KEYS_AT_ONCE`` keys at most; more keys are done in slices. Scoring
joins the coefficients to the rows and is column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import all_finite, complete_rows, spread_or_one
from ..operators.common import at_most, checkpointed, groups_of, join_on, key_list, plain_key, shuffle_width
from ..operators.quantiles import quantiles
from . import enfa, gam, glm
from .base import logistic

KEYS_AT_ONCE = 200_000  # keys whose coefficients travel to all tasks
ROWS_PER_PART = 200_000  # rows of a key that one task works on
START_ROWS = 50_000  # rows on which a key with more than four times as many takes its first rounds
START_PRESENCES = 1_000  # presences, and others, that such a share must be expected to hold
SETTLED = 1e-9  # relative step below which a key's coefficients have settled
HALVINGS = 30


@dataclass
class GroupedModel:
    """One fitted model per key. ``state`` has a row of coefficient arrays per key, ``failed`` the keys that cannot be fitted."""

    name: str
    predictors: list[str]
    keys: list[str]
    params: dict
    state: DataFrame
    failed: DataFrame

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Add the suitability in [0, 1] by each row's own key; NULL for a missing predictor or a key without a model."""
        held = self.state.withColumnsRenamed({c: f"_{c}" for c in self.state.columns if c not in self.keys})
        both = join_on(df, held, self.keys, "left", small=at_most(held, KEYS_AT_ONCE))
        both = _positions(self, both) if self.name == "gam" else both
        value = _FORMULAS[self.name](self)
        inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
        known = all_finite(self.predictors) & F.col("_mean" if self.name != "gam" else "_lows").isNotNull()
        return both.withColumn(out, F.when(known, inside)).select(*[c for c in df.columns if c != out], out)


def _described(rows: DataFrame, predictors, keys) -> DataFrame:
    """Counts, means, spreads and ranges of each key in one pass."""
    arrays = {"mean": lambda p: F.avg(p), "sd": lambda p: spread_or_one(F.stddev_pop(p)), "lows": lambda p: F.min(p), "highs": lambda p: F.max(p)}
    return checkpointed(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1"),
        *[F.array(*[f(p) for p in predictors]).alias(name) for name, f in arrays.items()]))


def _training(df: DataFrame, predictors, keys, label) -> DataFrame:
    return complete_rows(df, predictors).select(*keys, *[F.col(p).cast("double").alias(p) for p in predictors], F.col(label).cast("int").alias("label"))


# Designs: from a key's description to the matrix of its rows, and the penalty of the coefficients.


class _Logistic:
    def __init__(self, predictors, params):
        self.predictors, self.size = predictors, 1 + 2 * len(predictors)
        self.penalty = np.diag([0.0, *[1.0 / params["C"]] * (self.size - 1)])

    def matrix(self, x, about):
        z = (x - np.asarray(about["mean"])) / np.asarray(about["sd"])
        return np.hstack([np.ones((len(x), 1)), z, z * z])

    def curves(self, beta) -> list[tuple]:
        return []


class _Additive:
    def __init__(self, predictors, params):
        n = params["n_splines"]
        if n <= gam.ORDER:
            raise ValueError(f"a cubic spline needs more than {gam.ORDER} pieces")
        self.predictors, self.size, self.intervals = predictors, 1 + n * len(predictors), n - gam.ORDER
        bend = np.diff(np.eye(n), 2, axis=0)
        self.penalty = gam.RIDGE * np.eye(self.size)
        for i in range(len(predictors)):
            at = slice(1 + i * n, 1 + (i + 1) * n)
            self.penalty[at, at] += params["penalty"] * bend.T @ bend

    def matrix(self, x, about):
        out, n, at = np.zeros((len(x), self.size)), self.intervals + gam.ORDER, np.arange(len(x)) * self.size
        out[:, 0] = 1.0
        flat = out.reshape(-1)
        for i, (l, h) in enumerate(zip(about["lows"], about["highs"])):
            t = (x[:, i] - l) / ((h - l) / self.intervals if h > l else 1.0)
            j = np.clip(np.floor(t), 0, self.intervals - 1).astype(int)
            first = at + j + (1 + i * n)
            for k, w in enumerate(gam._weights(t - j)):
                flat[first + k] = w
        return out

    def curves(self, beta) -> list[tuple]:
        """Polynomial coefficients (constant first) of every predictor's curve: before its range, on every interval, beyond."""
        out = []
        for i in range(len(self.predictors)):
            n = self.intervals + gam.ORDER
            b = beta[1 + i * n:1 + (i + 1) * n]
            pieces, left, right = gam._pieces(b), (b[2] - b[0]) / 2, (b[-1] - b[-3]) / 2  # a step is the unit
            out += [(pieces[0, 0] - left, left, 0.0, 0.0), *pieces, (pieces[-1].sum(), right, 0.0, 0.0)]
        return [tuple(map(float, c)) for c in out]


def _sums(design, state, keys, predictors):
    """Partial sums of a task: per unsettled key the loss, the gradient and the curvature, without the penalty."""
    def work(batches):
        totals: dict = {}
        for pdf in batches:
            x_all, y_all = pdf[predictors].to_numpy(float), pdf["label"].to_numpy(float)
            for key, at in groups_of(pdf, keys):
                about = state.value.get(key)
                if about is None:
                    continue
                x, y = design.matrix(x_all[at], about), y_all[at]
                eta = np.clip(x @ about["beta"], -500, 500)
                mu = 1.0 / (1.0 + np.exp(-eta))
                wx = x * np.maximum(mu * (1 - mu), 1e-12)[:, None]
                loss = (np.logaddexp(0.0, eta) - y * eta).sum()
                flat = np.concatenate([[loss], x.T @ (mu - y), (x.T @ wx).ravel()])
                totals[key] = totals[key] + flat if key in totals else flat
        if totals:
            yield pd.DataFrame([(*k, v.tolist()) for k, v in totals.items()], columns=[*keys, "v"])

    return work


def _steps(design, state, keys):
    """New coefficients of the keys of a partition: (keys, beta, tried, best, halved, settled)."""
    size, penalty = design.size, design.penalty

    def work(batches):
        totals: dict = {}
        for pdf in batches:
            for *key, v in pdf[[*keys, "v"]].itertuples(index=False, name=None):
                key = plain_key(tuple(key))
                totals[key] = totals[key] + np.asarray(v) if key in totals else np.asarray(v, float)
        if not totals:
            return
        names = list(totals)
        sums = np.array([totals[k] for k in names])
        beta = np.array([state.value[k]["beta"] for k in names])
        loss = sums[:, 0] + 0.5 * np.einsum("ki,ij,kj->k", beta, penalty, beta)
        gradient, curvature = sums[:, 1:1 + size] + beta @ penalty, sums[:, 1 + size:].reshape(-1, size, size) + penalty
        move = -np.linalg.solve(curvature + 1e-12 * np.eye(size), gradient[:, :, None])[:, :, 0]
        out = []
        for k, b, l, m in zip(names, beta, loss, move):
            about = state.value[k]
            if about["best"] is not None and l > about["best"] + 1e-12 * abs(about["best"]) and about["halved"] < HALVINGS:
                out.append((*k, ((np.asarray(about["at"]) + b) / 2).tolist(), about["at"], about["best"], about["halved"] + 1, False))
            else:
                small = bool(np.linalg.norm(m) <= SETTLED * max(1.0, np.linalg.norm(b)))
                out.append((*k, (b + m).tolist(), b.tolist(), float(l), 0, small or about["halved"] >= HALVINGS))
        yield pd.DataFrame(out, columns=[*keys, "beta", "at", "best", "halved", "settled"])

    return work


def _newton(df: DataFrame, predictors, keys, label, design, max_iter: int):
    """(state with ``beta`` per key, keys that have a single class)."""
    spark, rows = df.sparkSession, _training(df, predictors, keys, label)
    about = _described(rows, predictors, keys)
    usable = about.where("n1 > 0 and n1 < n")
    failed = about.where("n1 = 0 or n1 = n").select(*keys, F.lit("fitting needs complete records of both classes").alias("error"))
    n_keys = usable.count()
    slices = max(1, -(-n_keys // KEYS_AT_ONCE))
    parts = usable.select(*keys, F.ceil(F.col("n") / ROWS_PER_PART).cast("int").alias("_parts"))
    dealt = join_on(rows, parts, keys, small=n_keys <= KEYS_AT_ONCE).withColumn("_part", F.pmod(F.xxhash64(*predictors), F.col("_parts")))
    width = shuffle_width(spark)
    placed = checkpointed(dealt.drop("_parts").repartition(width, *keys, "_part").sortWithinPartitions(*keys).drop("_part"))
    types = dict(rows.dtypes)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    def rounds(table, held):
        """Newton rounds over ``table`` for the keys of ``held``, whose coefficients they change; returns the keys that settled."""
        open_ = dict(held)
        for _ in range(max_iter):
            state = spark.sparkContext.broadcast(open_)
            partial = table.mapInPandas(_sums(design, state, keys, predictors), f"{key_schema}, v array<double>").repartition(width, *keys)
            got = partial.mapInPandas(_steps(design, state, keys), f"{key_schema}, beta array<double>, at array<double>, best double, halved int, settled boolean").collect()
            state.unpersist()
            for r in got:
                key = tuple(r[k] for k in keys)
                held[key] |= {k: r[k] for k in ("beta", "at", "best", "halved")}
                if r["settled"]:
                    open_.pop(key, None)
            if not open_:
                break
        return set(held) - set(open_)

    many = (F.col("n") > 4 * START_ROWS) & (F.least("n1", F.col("n") - F.col("n1")) * START_ROWS >= F.col("n") * START_PRESENCES)
    started = usable.where(many).select(*keys, F.col("n").alias("_n"))
    n_started = started.count()
    if n_started:
        share = F.pmod(F.xxhash64(F.lit(1), *predictors), F.col("_n")) < START_ROWS
        first = checkpointed(join_on(placed, started, keys, small=n_started <= KEYS_AT_ONCE).where(share).drop("_n"))
    done = None
    for part in range(slices):
        chosen = usable if slices == 1 else usable.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == part)
        held, large = {}, []
        for r in chosen.withColumn("_many", many).toLocalIterator():
            share, key = r["n1"] / r["n"], tuple(r[k] for k in keys)
            held[key] = {"mean": r["mean"], "sd": r["sd"], "lows": r["lows"], "highs": r["highs"], "best": None, "at": None, "halved": 0,
                         "beta": [float(np.log(share / (1 - share))), *[0.0] * (design.size - 1)]}
            large += [key] if r["_many"] else []
        if large:
            trial = {k: dict(held[k]) for k in large}
            for k in rounds(first, trial):  # a key that did not settle on its share starts like the others
                held[k]["beta"] = trial[k]["beta"]
        rounds(placed, held)
        one = spark.createDataFrame([(*k, [float(v) for v in h["beta"]], design.curves(h["beta"])) for k, h in held.items()], f"{key_schema}, beta array<double>, curves array<struct<c0: double, c1: double, c2: double, c3: double>>")
        done = one if done is None else done.union(one)
    return checkpointed(join_on(usable, done, keys, small=n_keys <= KEYS_AT_ONCE)), failed


def _fit_lr(df, predictors, keys, label, params):
    state, failed = _newton(df, predictors, keys, label, _Logistic(predictors, params), params["max_iter"])
    return state.select(*keys, "n", "mean", "sd", "beta"), failed


def _fit_gam(df, predictors, keys, label, params):
    design = _Additive(predictors, params)
    state, failed = _newton(df, predictors, keys, label, design, params["max_iter"])
    steps = F.transform(F.arrays_zip("lows", "highs"), lambda x: F.when(x["highs"] > x["lows"], (x["highs"] - x["lows"]) / design.intervals).otherwise(1.0))
    return state.select(*keys, "n", "lows", steps.alias("steps"), "beta", "curves"), failed


def _fit_enfa(df, predictors, keys, label, params):
    rows, p = _training(df, predictors, keys, label), len(predictors)
    at_presence = lambda c: F.when(F.col("label") == 1, F.col(c))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    about = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1"), F.array(*[F.avg(c) for c in predictors]).alias("mean"),
        F.array(*[spread_or_one(F.stddev_pop(c)) for c in predictors]).alias("sd"), F.array(*[F.avg(at_presence(c)) for c in predictors]).alias("presence"),
        F.array(*[F.covar_samp(at_presence(predictors[i]), at_presence(predictors[j])) for i, j in pairs]).alias("spread"))
    about = checkpointed(about)
    usable, types = about.where("n1 > 1 and n1 < n"), dict(rows.dtypes)
    failed = about.where("n1 < 2 or n1 = n").select(*keys, F.lit("niche factor analysis needs at least 2 presences and records of both classes").alias("error"))

    def invert(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sd, mean, at = (np.array(pdf[c].tolist()) for c in ("sd", "mean", "presence"))
            cov = np.zeros((len(pdf), p, p))
            for (i, j), v in zip(pairs, np.array(pdf["spread"].tolist()).T):
                cov[:, i, j] = cov[:, j, i] = v / sd[:, i] / sd[:, j]
            precision = np.linalg.pinv(cov + np.eye(p) * params["ridge"], hermitian=True)
            yield pdf[[*keys, "n", "mean", "sd"]].assign(centre=list((at - mean) / sd), precision=list(precision.reshape(len(pdf), -1)))

    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    state = checkpointed(usable.mapInPandas(invert, f"{key_schema}, n bigint, mean array<double>, sd array<double>, centre array<double>, precision array<double>"))
    held = state.withColumnsRenamed({c: f"_{c}" for c in ("n", "mean", "sd", "centre", "precision")})
    near = join_on(rows.where("label = 1"), held, keys, small=at_most(held, KEYS_AT_ONCE)).select(*keys, _niche_distance(predictors).alias("d"))
    scale = quantiles(near, ["d"], [enfa.SCALE_QUANTILE], keys).select(*keys, F.when(F.col("d")[0] > 0, F.col("d")[0]).otherwise(1.0).alias("scale"))
    return checkpointed(join_on(state, scale, keys)), failed


# Formulas over the joined coefficient columns


def _standard(predictors):
    return [(F.col(p) - F.col("_mean")[i]) / F.col("_sd")[i] for i, p in enumerate(predictors)]


def _niche_distance(predictors):
    d = [z - F.col("_centre")[i] for i, z in enumerate(_standard(predictors))]
    n = len(d)
    total = reduce(lambda a, b: a + b, [d[i] * d[j] * F.col("_precision")[i * n + j] for i in range(n) for j in range(n)])
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _lr_formula(m: GroupedModel):
    z = _standard(m.predictors)
    return logistic(reduce(lambda a, b: a + b, [t * F.col("_beta")[i + 1] for i, t in enumerate(z + [c * c for c in z])], F.col("_beta")[0]))


def _positions(m: GroupedModel, both: DataFrame) -> DataFrame:
    """Each predictor's place on its spline, in steps (``_t``), the interval it is in (``_j``) and the curve there (``_c``).

    Columns of their own: written into one formula they are repeated until it outgrows what is compiled.
    """
    intervals, each = m.params["n_splines"] - gam.ORDER, range(len(m.predictors))
    both = both.withColumns({f"_t{i}": (F.col(m.predictors[i]) - F.col("_lows")[i]) / F.col("_steps")[i] for i in each})
    both = both.withColumns({f"_j{i}": F.least(F.lit(intervals), F.greatest(F.lit(-1), F.floor(f"_t{i}"))).cast("int") for i in each})
    return both.withColumns({f"_c{i}": F.get("_curves", F.col(f"_j{i}") + (1 + i * (intervals + 2))) for i in each})


def _gam_formula(m: GroupedModel):
    total = F.col("_beta")[0]
    for i in range(len(m.predictors)):
        u, c = F.col(f"_t{i}") - F.col(f"_j{i}"), F.col(f"_c{i}")
        total = total + (c.c0 + u * (c.c1 + u * (c.c2 + u * c.c3)))
    return F.nanvl(logistic(total), F.lit(0.5))


def _enfa_formula(m: GroupedModel):
    return F.exp(-_niche_distance(m.predictors) / F.col("_scale"))


_FITS = {"lr": (glm.DEFAULTS, _fit_lr), "gam": (gam.DEFAULTS, _fit_gam), "enfa": (enfa.DEFAULTS, _fit_enfa)}
_FORMULAS = {"lr": _lr_formula, "gam": _gam_formula, "enfa": _enfa_formula}


def fit_by(name: str, df: DataFrame, predictors, keys, label: str = "label", **params) -> GroupedModel:
    """Fit one model per key on its complete rows. A key that cannot be fitted is listed as failed; a null key is a key."""
    if name not in _FITS:
        raise ValueError(f"{name!r} has no grouped fit; choose from {sorted(_FITS)}")
    base, fitted = _FITS[name]
    if unknown := set(params) - set(base):
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    keys, predictors, params = key_list(keys), list(predictors), {**base, **params}
    state, failed = fitted(df, predictors, keys, label, params)
    return GroupedModel(name, predictors, keys, params, state, failed)
