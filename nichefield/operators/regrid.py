"""Moving layers onto another grid. Interpolation looks up source cells around each target
centre; area methods send each source cell to the target cells it overlaps."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coordinates import transform_xy
from ..grid import CEIL_SLACK, Grid, Layer
from .cells import mask_nodata
from .quantiles import IN_TASK_ROWS, quantiles

# Resampling methods, default method, cubic convolution coefficient.
METHODS = ("nearest", "bilinear", "cubic", "average", "mode", "median", "min", "max")
DEFAULT_METHOD = "bilinear"
CUBIC_A = -0.5


def target_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell of a grid, generated in parallel."""
    cells = spark.range(grid.n_cells)
    return cells.select(F.floor(F.col("id") / grid.width).cast("int").alias("row"),
                        (F.col("id") % grid.width).cast("int").alias("col"))


def regrid(layer_values: DataFrame, layers: list[Layer], target: Grid, methods="bilinear") -> DataFrame:
    """K6-K8: every layer on ``target``; cells no source value reaches are NULL.

    ``methods`` is one method for all layers or a mapping by layer name.
    """
    chosen = {l.name: methods if isinstance(methods, str) else methods.get(l.name, DEFAULT_METHOD) for l in layers}
    bad = sorted(set(chosen.values()) - set(METHODS))
    if bad:
        raise ValueError(f"unknown resampling method {bad}")
    values = mask_nodata(layer_values, layers).where(F.col("value").isNotNull()).select("layer", "row", "col", "value")
    # Layers of one grid and method move together: one scan, with the layer as a key.
    together: dict = {}
    for layer in layers:
        together.setdefault((layer.grid, chosen[layer.name]), []).append(layer.name)
    moved = [_regrid_together(values.where(F.col("layer").isin(names)), names, grid, target, method)
             for (grid, method), names in together.items()]
    return reduce(DataFrame.unionByName, moved).select("layer", "row", "col", "value")


def _regrid_together(source: DataFrame, names: list[str], grid: Grid, target: Grid, method: str) -> DataFrame:
    cells = target_cells(source.sparkSession, target).withColumn("layer", F.explode(F.array(*[F.lit(n) for n in names])))
    if method in ("nearest", "bilinear", "cubic"):
        return _interpolated(source, cells, grid, target, method)
    found = cells.join(_pooled(source, grid, target, method), ["layer", "row", "col"], "left")
    if grid.crs == target.crs:
        return found
    # Between coordinate systems source cells count by their centres: a target cell without any takes the source
    # cell that it lies in.
    inside = _interpolated(source, cells, grid, target, "nearest").withColumnRenamed("value", "_at")
    return found.join(inside, ["layer", "row", "col"], "left").withColumn("value", F.coalesce("value", "_at"))


def _source_position(grid: Grid, target: Grid) -> tuple[Column, Column]:
    """Target centre in source cells: column and row as real numbers from the source's corner."""
    x = F.lit(target.minx) + (F.col("col") + 0.5) * target.res_x
    y = F.lit(target.maxy) - (F.col("row") + 0.5) * target.res_y
    x, y = transform_xy(x, y, target.crs, grid.crs)
    return (x - grid.minx) / grid.res_x, (F.lit(grid.maxy) - y) / grid.res_y


def _cubic(t: Column) -> Column:
    d, a = F.abs(t), CUBIC_A
    near = (d * (a + 2.0) - (a + 3.0)) * d * d + 1.0
    far = ((d * a - 5.0 * a) * d + 8.0 * a) * d - 4.0 * a
    return F.when(d <= 1.0, near).when(d < 2.0, far).otherwise(0.0)


def _interpolated(source: DataFrame, cells: DataFrame, grid: Grid, target: Grid, method: str) -> DataFrame:
    u, v = _source_position(grid, target)
    held = source.select("layer", F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    if method == "nearest":
        at = cells.select("layer", "row", "col", F.floor(v).alias("_r"), F.floor(u).alias("_c"))
        return at.join(held, ["layer", "_r", "_c"], "left").select("layer", "row", "col", "value")
    reach = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
    # Nothing is made up for a target centre outside the source grid.
    within = (u >= 0) & (u < grid.width) & (v >= 0) & (v < grid.height)
    placed = cells.withColumns({"_u": u - 0.5, "_v": v - 0.5, "_in": within})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach]))
    near = placed.withColumn("_o", around).withColumns(
        {"_c": F.floor("_u") + F.col("_o.i"), "_r": F.floor("_v") + F.col("_o.j")})
    du, dv = F.col("_u") - F.col("_c"), F.col("_v") - F.col("_r")
    weight = ((1.0 - F.abs(du)) * (1.0 - F.abs(dv))) if method == "bilinear" else _cubic(du) * _cubic(dv)
    met = near.select("layer", "row", "col", "_r", "_c", F.when(F.col("_in"), weight).alias("_w")).join(held, ["layer", "_r", "_c"], "left")
    mass = F.sum(F.when(F.col("value").isNotNull(), F.col("_w")))
    return met.groupBy("layer", "row", "col").agg(
        F.when(F.abs(mass) > 1e-9, F.sum(F.col("value") * F.col("_w")) / mass).alias("value"))


def _pooled(source: DataFrame, grid: Grid, target: Grid, method: str) -> DataFrame:
    met = _overlaps(source, grid, target)
    group = met.groupBy("layer", "row", "col")
    if method == "average":
        return group.agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))
    if method in ("min", "max"):
        return group.agg((F.min if method == "min" else F.max)("value").alias("value"))
    if method == "mode":  # counted by value first, so a huge target cell is never one task's list
        counts = met.groupBy("layer", "row", "col", "value").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("layer", "row", "col").agg((-F.max(F.struct("n", (-F.col("value")).alias("v")))["v"]).alias("value"))
    per_target = math.ceil(target.res_x / grid.res_x + 1) * math.ceil(target.res_y / grid.res_y + 1)
    if grid.crs == target.crs and per_target <= IN_TASK_ROWS:
        return group.agg(F.percentile("value", 0.5).alias("value"))
    return quantiles(met, ["value"], [0.5], ["layer", "row", "col"], in_task_rows=0).select(
        "layer", "row", "col", F.col("value")[0].alias("value"))


def _overlaps(source: DataFrame, grid: Grid, target: Grid) -> DataFrame:
    """Source values with each target cell they overlap and the overlapping share.

    Between coordinate systems a source cell counts for the target cell its centre falls into.
    """
    if grid.crs != target.crs:
        x = F.lit(grid.minx) + (F.col("col") + 0.5) * grid.res_x
        y = F.lit(grid.maxy) - (F.col("row") + 0.5) * grid.res_y
        x, y = transform_xy(x, y, grid.crs, target.crs)
        row, col = F.floor((F.lit(target.maxy) - y) / target.res_y), F.floor((x - target.minx) / target.res_x)
        return source.select("layer", row.cast("int").alias("row"), col.cast("int").alias("col"), "value", F.lit(1.0).alias("_w")) \
            .where((F.col("row") >= 0) & (F.col("row") < target.height) & (F.col("col") >= 0) & (F.col("col") < target.width))
    left = (F.lit(grid.minx - target.minx) + F.col("col") * grid.res_x) / target.res_x
    top = (F.lit(target.maxy - grid.maxy) + F.col("row") * grid.res_y) / target.res_y
    spans = source.select("layer", "value", left.alias("x0"), (left + grid.res_x / target.res_x).alias("x1"),
                          top.alias("y0"), (top + grid.res_y / target.res_y).alias("y1"))

    def reached(low: str, high: str, n: int) -> Column:
        first = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col(low) + CEIL_SLACK))
        last = F.least(F.lit(n - 1).cast("bigint"), F.ceil(F.col(high) - CEIL_SLACK) - 1)
        return F.when(first <= last, F.sequence(first, last))

    met = spans.withColumn("col", F.explode(reached("x0", "x1", target.width))).withColumn(
        "row", F.explode(reached("y0", "y1", target.height)))

    def share(low: str, high: str, at: str) -> Column:
        return F.least(F.col(high), F.col(at) + 1.0) - F.greatest(F.col(low), F.col(at).cast("double"))

    return met.select("layer", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value",
                      (share("x0", "x1", "col") * share("y0", "y1", "row")).alias("_w"))
