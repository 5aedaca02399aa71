"""Predictor selection by variance inflation, from one aggregation of cross-products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complete_rows
from .common import key_list

# Default cutoff and the ceiling of R-squared (a perfect fit scores one million).
DEFAULT_CUTOFF = 10.0
MAX_R2 = 0.999999


def cross_products(df: DataFrame, cols, keys=()) -> DataFrame:
    """Population covariance matrix of ``cols`` as one flat array per key, upper triangle by rows.

    This one pass over the data is all that any later selection step needs.
    """
    entries = []
    for i, a in enumerate(cols):
        entries.append(F.var_pop(a))
        entries += [F.covar_pop(a, b) for b in cols[i + 1:]]
    return complete_rows(df, cols).groupBy(*key_list(keys)).agg(F.array(*entries).alias("cov"))


def _inflation(cov: np.ndarray) -> np.ndarray:
    """VIF of each column given the covariance matrix; infinite for a constant column."""
    out = np.full(len(cov), np.inf)
    for i, variance in enumerate(np.diag(cov)):
        if variance <= 0:
            continue
        rest = np.arange(len(cov)) != i
        scale = np.sqrt(np.diag(cov)[rest])
        scale[scale == 0] = 1.0
        link = cov[i, rest] / scale
        explained = link @ np.linalg.pinv(cov[np.ix_(rest, rest)] / np.outer(scale, scale)) @ link
        out[i] = 1.0 / (1.0 - min(max(explained / variance, 0.0), MAX_R2))
    return out


def _unpack(flat, p: int) -> np.ndarray:
    cov = np.zeros((p, p))
    cov[np.triu_indices(p)] = flat
    return cov + np.triu(cov, 1).T


def _select_rows(cols, cutoff: float | None):
    """Steps of one matrix as (step, feature, vif, dropped); ``cutoff`` None = a single look."""
    def run(flat):
        cov, names, step, rows = _unpack(flat, len(cols)), list(cols), 0, []
        while len(names) >= (1 if cutoff is None else 2):
            vif = _inflation(cov)
            worst = int(np.argmax(vif))
            stop = cutoff is None or (np.isfinite(vif[worst]) and vif[worst] <= cutoff)
            rows += [(step, n, float(v), not stop and i == worst) for i, (n, v) in enumerate(zip(names, vif))]
            if stop:
                break
            keep = np.arange(len(names)) != worst
            cov, names, step = cov[np.ix_(keep, keep)], [n for n, k in zip(names, keep) if k], step + 1
        return rows
    return run


def vif_steps(df: DataFrame, cols, cutoff: float | None = DEFAULT_CUTOFF, keys=()) -> DataFrame:
    """Every elimination step: feature, its VIF, and whether it is dropped there.

    Python sees one small matrix per key; the data pass is the aggregation before it.
    """
    if cutoff is not None and cutoff <= 1:
        raise ValueError("the cutoff must be greater than 1")
    keys, cols = key_list(keys), list(cols)
    matrices = cross_products(df, cols, keys).where(F.col("cov").isNotNull())
    steps = _select_rows(cols, cutoff)
    fields = [f for f in matrices.schema.fields if f.name in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["step int", "feature string", "vif double", "dropped boolean"])

    def per_matrix(batches):
        for pdf in batches:
            rows = [(*[getattr(r, k) for k in keys], *s) for r in pdf.itertuples()
                    for s in steps(np.asarray(r.cov, dtype=float))]
            yield pd.DataFrame(rows, columns=[*keys, "step", "feature", "vif", "dropped"])

    return matrices.mapInPandas(per_matrix, schema)


def vif(df: DataFrame, cols, keys=()) -> DataFrame:
    """Variance inflation of each column given all the others."""
    return vif_steps(df, cols, None, keys).select(*key_list(keys), "feature", "vif")


def retained(steps: DataFrame, cols, keys=()) -> DataFrame:
    """Predictors that survive, with their position in the original order."""
    keys = key_list(keys)
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")) - 1
    return (steps.groupBy(*keys, "feature").agg(F.max(F.col("dropped").cast("int")).alias("_dropped"))
            .where("_dropped = 0").select(*keys, "feature", order.cast("int").alias("position")))


def stepwise_vif(df: DataFrame, cols, cutoff: float = DEFAULT_CUTOFF, enabled: bool = True):
    """Kept predictor names (in input order) and the step table, for one set of records.

    ``enabled=False`` keeps every predictor. At most p rows per step reach the driver.
    """
    cols = list(cols)
    if not enabled or len(cols) < 2:
        return cols, None
    steps = vif_steps(df, cols, cutoff)
    rows = steps.collect()
    gone = {r.feature for r in rows if r.dropped}
    spark = df.sparkSession
    return [c for c in cols if c not in gone], spark.createDataFrame(rows, steps.schema)
