"""How far a second grid lies from the training conditions: MESS and MOP.

The training records are the small side. Below a checked bound they are broadcast and the cell
table is mapped without a shuffle; beyond it both measures have a distributed exact form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import all_finite, complete_rows
from .cells import moments
from .common import BROADCAST_ROWS, at_most, attach, checkpointed, groups_of, join_on, key_list, plain_key, range_parts
from .nearest import MAX_BOXES, MOST_POINTS, POINT_BOXES, SAMPLE_ROWS, TABLE_BOX, BoxIndex, boxed, in_order, meet

BROADCAST_VALUES = 2_000_000  # training numbers held in memory by a task
MIN_SPAN = 1e-9  # fixed value: floor of a predictor's training range
DEFAULT_PERCENTILE = 10.0


def _schema(df: DataFrame, keys, extra: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys]
    return ", ".join([*kept, extra])


def _training_values(training: DataFrame, predictors, keys) -> DataFrame:
    """Distinct training values with counts: keys, f, v, c."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(p).cast("double").alias("v"))
                               for i, p in enumerate(predictors)]))
    long = complete_rows(training, predictors).select(*keys, each.alias("_e"))
    return long.groupBy(*keys, F.col("_e.f").alias("f"), F.col("_e.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def mess(cells: DataFrame, training: DataFrame, predictors, keys=(),
         broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Similarity to the training range per cell; negative = beyond it, NULL = incomplete cell.

    With ``keys`` both tables carry them and each cell is compared with its own training records.
    """
    keys, predictors = key_list(keys), list(predictors)
    values = _training_values(training, predictors, keys)
    wanted = cells.select(*keys, "row", "col", *[F.col(p).cast("double").alias(p) for p in predictors])
    values = checkpointed(values)
    if at_most(values, broadcast_values):
        return _mess_broadcast(wanted, values, predictors, keys)
    return _mess_shuffled(wanted, values, predictors, keys)


def _similarity(f, n, v, low, high):
    """Vectorised similarity of values ``v`` of which ``f`` of ``n`` training values are not above."""
    span = max(high - low, MIN_SPAN)
    inside = np.minimum(f, n - f) / n * 200.0
    return np.where(v < low, (v - low) / span * 100.0, np.where(v > high, (high - v) / span * 100.0, inside))


def _mess_broadcast(cells, values, predictors, keys):
    held: dict = {}
    table = values.toPandas().sort_values("v")
    for at, part in table.groupby([*keys, "f"], sort=False, dropna=False):
        held[plain_key(at)] = (part["v"].to_numpy(), np.concatenate([[0], part["c"].to_numpy().cumsum()]))
    shared = cells.sparkSession.sparkContext.broadcast(held)

    def per_task(batches):
        curves = shared.value
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            x = pdf[predictors].to_numpy(float)
            for key, at in groups_of(pdf, keys):
                if (*key, 0) not in curves:
                    continue
                worst = np.full(len(at), np.inf)
                for i in range(len(predictors)):
                    known, upto = curves[(*key, i)]
                    v = x[at, i]
                    f = upto[np.searchsorted(known, v, side="right")]
                    worst = np.minimum(worst, _similarity(f, upto[-1], v, known[0], known[-1]))
                out[at] = np.where(np.isfinite(x[at]).all(axis=1), worst, np.nan)
            done = pdf[[*keys, "row", "col"]].copy()
            done["mess"] = out
            yield done

    types = dict(cells.dtypes)
    schema = _schema(cells, keys, f"row {types['row']}, col {types['col']}, mess double")
    return cells.mapInPandas(per_task, schema).withColumn("mess", F.when(~F.isnan("mess"), F.col("mess")))


def _mess_shuffled(cells, values, predictors, keys):
    """Rank every distinct cell value among the training values, then join the result back."""
    by = [*keys, "f"]
    whole = complete_rows(cells, predictors)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(p).alias("v")) for i, p in enumerate(predictors)]))
    long = whole.select(*keys, "row", "col", each.alias("_e")).select(*keys, "row", "col", "_e.f", "_e.v")
    asked = long.select(*by, "v").distinct().withColumn("c", F.lit(0).cast("bigint"))
    both = values.unionByName(asked).groupBy(*by, "v").agg(F.sum("c").alias("c"))
    parts = checkpointed(range_parts(both, [*by, "v"]))
    sizes = parts.groupBy(*by, "_part").agg(F.sum("c").alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    spans = values.groupBy(*by).agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    f = F.sum("c").over(W.partitionBy(*by, "_part").orderBy("v")) + F.col("_off")
    ranked = join_on(join_on(parts, offsets, [*by, "_part"]).withColumn("below", f), spans, by)
    span = F.greatest(F.col("high") - F.col("low"), F.lit(MIN_SPAN))
    sim = (F.when(F.col("v") < F.col("low"), (F.col("v") - F.col("low")) / span * 100.0)
           .when(F.col("v") > F.col("high"), (F.col("high") - F.col("v")) / span * 100.0)
           .otherwise(F.least(F.col("below"), F.col("n") - F.col("below")) / F.col("n") * 200.0))
    # Cells whose key has no training records keep their row, with NULL.
    scored = join_on(long, ranked.select(*by, "v", sim.alias("sim")), [*by, "v"], "left")
    found = scored.groupBy(*keys, "row", "col").agg(F.min("sim").alias("mess"))
    rest = cells.where(~all_finite(predictors)).select(*keys, "row", "col", F.lit(None).cast("double").alias("mess"))
    return found.unionByName(rest)


def nearest_count(n: int, percentile: float) -> int:
    """Training rows averaged over: the share of ``n`` rounded half to even, at least one."""
    return max(1, round(n * percentile / 100.0))


def mop(cells: DataFrame, training: DataFrame, predictors, percentile: float = DEFAULT_PERCENTILE,
        broadcast_values: int = BROADCAST_VALUES, keys=(), distances: bool = False) -> DataFrame:
    """Mean standardised distance to the nearest share of training records, per cell.

    With ``keys`` each cell is standardised by and compared with its own key's records; a key without records gives
    NULL. Both forms go through boxes of training records (``nearest``), so that only distances that enter the mean, and
    those of a thin shell around, are computed. ``distances`` adds how many were computed for the cell's vector.
    """
    predictors, keys = list(predictors), key_list(keys)
    known = complete_rows(training, predictors).select(*keys, *[F.col(p).cast("double").alias(p) for p in predictors])
    stats = checkpointed(moments(known, predictors, keys))
    few = at_most(stats, BROADCAST_ROWS)

    def scaled(df, *keep):
        there = join_on(df, stats, keys, "left", small=few) if keys else attach(df, stats, ())
        return there.select(*keys, *keep, *[((F.col(p).cast("double") - F.col(f"{p}__mean")) / F.col(f"{p}__sd")).alias(p)
                                            for p in predictors])

    rows = checkpointed(scaled(known).groupBy(*keys, *predictors).agg(F.count(F.lit(1)).alias("c")))
    wanted = scaled(cells, "row", "col")
    within = at_most(rows, broadcast_values // len(predictors))
    scored = (_mop_broadcast if within else _mop_boxed)(wanted, rows, predictors, percentile, keys)
    return scored.select(*keys, "row", "col", "mop", *(["distances"] if distances else []))


def _mop_broadcast(cells, rows, predictors, percentile, keys=()):
    table = rows.toPandas()
    shared = cells.sparkSession.sparkContext.broadcast({
        key: BoxIndex(table[predictors].to_numpy(float)[at], table["c"].to_numpy()[at]) for key, at in groups_of(table, keys) if len(at)})

    def per_task(batches):
        for pdf in batches:
            x = pdf[predictors].to_numpy(float)
            ok = np.isfinite(x).all(axis=1)
            out, computed = np.full(len(pdf), np.nan), np.zeros(len(pdf), np.int64)
            for key, at in groups_of(pdf, keys):
                at, index = at[ok[at]], shared.value.get(key)
                if len(at) and index:
                    distinct, back = np.unique(x[at], axis=0, return_inverse=True)
                    mean, done = index.mean(distinct, nearest_count(index.n, percentile))
                    out[at], computed[at] = mean[back.ravel()], done[back.ravel()]
            done = pdf[[*keys, "row", "col"]].copy()
            done["mop"], done["distances"] = out, computed
            yield done

    types = dict(cells.dtypes)
    schema = _schema(cells, keys, f"row {types['row']}, col {types['col']}, mop double, distances bigint")
    sample = table[predictors].to_numpy(float)[::max(1, len(table) // SAMPLE_ROWS)]
    return in_order(cells, predictors, keys, sample).mapInPandas(per_task, schema).withColumn("mop", F.when(~F.isnan("mop"), F.col("mop")))


def _mop_boxed(cells, rows, predictors, percentile, keys=(), row_box: int = TABLE_BOX, point_box: int = 0):
    """The same with training records that no task holds: boxes of distinct cells meet the boxes of records they need."""
    keys = key_list(keys)
    whole = complete_rows(cells, predictors)
    number = lambda df: checkpointed(df.withColumn("vid", F.monotonically_increasing_id()))
    vectors = number(whole.select(*keys, *predictors).distinct().withColumn("c", F.lit(1).cast("bigint")))
    records = number(rows)
    row_boxes = boxed(records, predictors, keys, "vid", max(row_box, records.count() // MAX_BOXES))
    point_boxes = boxed(vectors, predictors, keys, "vid", point_box or max(TABLE_BOX, min(MOST_POINTS, vectors.count() // POINT_BOXES)))
    found = meet(point_boxes, row_boxes, predictors, keys, lambda n: nearest_count(n, percentile), plain_key)
    by_vector = vectors.join(found, "vid").select(*keys, *predictors, F.col("mean").alias("mop"), "distances")
    rest = cells.where(~all_finite(predictors)).select(*keys, "row", "col", F.lit(None).cast("double").alias("mop"), F.lit(0).cast("bigint").alias("distances"))
    return join_on(whole, by_vector, [*keys, *predictors], "left").select(*keys, "row", "col", "mop", F.coalesce("distances", F.lit(0)).alias("distances")).unionByName(rest)


def extrapolation_share(scored: DataFrame, keys=()) -> DataFrame:
    """Share of cells outside the training range and the symmetric display limit."""
    return scored.groupBy(*key_list(keys)).agg(
        F.avg((F.col("mess") < 0).cast("int")).alias("extrapolated_share"),
        F.coalesce(F.max(F.abs("mess")), F.lit(1.0)).alias("display_limit"))
