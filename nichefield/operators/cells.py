"""Cell tables: stacking layers, masking, statistics, extraction at points, standardising."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_number, finite, spread_or_one, with_cell
from ..grid import Grid, Layer
from .common import BROADCAST_ROWS, at_most, attach, checkpointed, key_list
from .layers import check_stackable



def mask_nodata(layer_values: DataFrame, layers: list[Layer]) -> DataFrame:
    """A4: each layer's own missing-value marker (and NaN) becomes NULL.

    Markers are a handful of per-layer constants, so they are folded into one expression
    instead of a join.
    """
    marked = [l for l in layers if l.nodata is not None and not math.isnan(l.nodata)]
    is_marker = reduce(
        lambda acc, l: acc | ((F.col("layer") == l.name) & (F.col("value") == F.lit(float(l.nodata)))),
        marked, F.lit(False))
    return layer_values.withColumn("value", F.when(~is_marker, clean_number("value")))


def build_cells(layer_values: DataFrame, layers: list[Layer], keys=()) -> DataFrame:
    """A3: one row per cell with one column per layer, in layer order."""
    check_stackable(layers)
    keys = key_list(keys)
    grid, names = layers[0].grid, [l.name for l in layers]
    wide = (mask_nodata(layer_values, layers)
            .groupBy(*keys, "row", "col")
            .agg(*[F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in names]))
    x = F.lit(grid.minx) + (F.col("col") + 0.5) * grid.res_x
    y = F.lit(grid.maxy) - (F.col("row") + 0.5) * grid.res_y
    return wide.select(*keys, "row", "col", x.alias("x"), y.alias("y"), *names)


def _dtype_kind(dtype: str) -> str:
    """What a storage type holds, as numpy sorts it; a name numpy does not know stands for itself."""
    try:
        kind = np.dtype(dtype.lower()).kind
    except TypeError:
        return dtype
    return {"i": "integer", "u": "integer", "f": "decimal", "c": "decimal"}.get(kind, dtype)


def layer_stats(layer_values: DataFrame, layers: list[Layer],
                sample_cap: int | None = None) -> DataFrame:
    """Min, max, mean, population SD and valid share per layer.

    Exact by default. With ``sample_cap`` a layer above that many cells is read on a regular
    stride in both directions, as a quick look at a huge layer.
    """
    strides = {l.name: 1 if not sample_cap or l.width * l.height <= sample_cap
               else max(1, int(math.sqrt(l.width * l.height / sample_cap))) for l in layers}
    values = mask_nodata(layer_values, layers)
    keep = reduce(lambda acc, kv: acc | ((F.col("layer") == kv[0]) & (F.col("row") % kv[1] == 0)
                                         & (F.col("col") % kv[1] == 0)),
                  strides.items(), F.lit(False))
    size = F.create_map(*[F.lit(v) for l in layers for v in
                          (l.name, -(-l.width // strides[l.name]) * -(-l.height // strides[l.name]))])
    kind = F.create_map(*[F.lit(v) for l in layers for v in (l.name, _dtype_kind(l.dtype))])
    sampled = F.create_map(*[F.lit(v) for l in layers for v in (l.name, strides[l.name] > 1)])
    stats = values.where(keep).groupBy("layer").agg(
        F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.count("value").alias("n_valid"))
    return stats.select(
        "layer", kind[F.col("layer")].alias("kind"), "minimum", "maximum", "mean", "sd", "n_valid",
        (F.col("n_valid") / size[F.col("layer")]).alias("valid_fraction"),
        sampled[F.col("layer")].alias("sampled"))


def extract(points: DataFrame, cells: DataFrame, predictors, keys=(), cell_keys=(),
            broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Predictor values at points that carry ``row`` and ``col``; NULL off-grid or missing.

    Points are first reduced to the distinct cells they touch, so a cell that holds a third of all
    points is looked up once. When those cells are few they are broadcast, the cell table is
    filtered where it is read, and what is left of it is broadcast to the points: neither large
    table is shuffled. Otherwise both sides shuffle on the cell.
    """
    on = [*key_list(cell_keys), "row", "col"]
    touched = checkpointed(points.select(*on).distinct())  # counted and joined, computed once
    wanted = cells.select(*on, *predictors)
    if at_most(touched, broadcast_rows):
        wanted = F.broadcast(wanted.join(F.broadcast(touched), on, "left_semi"))
    else:
        wanted = wanted.join(touched, on, "left_semi")
    return points.join(wanted, on, "left")


def extract_at(points: DataFrame, cells: DataFrame, grid: Grid, predictors, **kw) -> DataFrame:
    return extract(with_cell(points, grid), cells, predictors, **kw)


def moments(df: DataFrame, cols, keys=()) -> DataFrame:
    """Mean and population SD of every column in one pass (a constant column gets SD 1)."""
    return df.groupBy(*key_list(keys)).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in cols],
        *[spread_or_one(F.stddev_pop(c)).alias(f"{c}__sd") for c in cols])


def standardise(df: DataFrame, cols, keys=(), suffix: str = "") -> DataFrame:
    """Subtract the mean, divide by the population SD."""
    keep = [c for c in df.columns if suffix or c not in cols]
    scaled = [((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__sd")).alias(c + suffix) for c in cols]
    return attach(df, moments(df, cols, keys), keys).select(*keep, *scaled)


def add_squares(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({f"{c}_sq": F.col(c) * F.col(c) for c in cols})


def surface_encoded(surface: DataFrame, value: str = "value", dtype: str = "float32",
                    nodata: float = -9999.0) -> DataFrame:
    """A surface as it is stored: missing values replaced by the marker, cast to the type."""
    from .layers import nodata_fits, storage

    if not nodata_fits(nodata, dtype):
        raise ValueError(f"nodata {nodata:g} cannot be stored as {dtype}")
    stored = F.when(finite(value), F.col(value)).otherwise(F.lit(float(nodata)))
    return surface.withColumn(value, stored.cast(storage(dtype)[0]))
