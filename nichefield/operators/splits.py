"""Cross-validation splits as columns. Order is a seeded hash of the row's id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import hash_uniform
from ..functions.scalars import finite, with_cell
from ..grid import DEFAULT_SEED, Grid
from .cells import extract
from .common import attach, key_list, lookup, ordinal, shuffled

# Defaults of the split methods and of the block-size estimate.
REPLICATE_STRIDE = 101
DEFAULT_K = 5
DEFAULT_TEST_SIZE = 0.25
VARIOGRAM_SAMPLES = 2000
VARIOGRAM_MIN_VALID = 200
VARIOGRAM_PAIRS = 20_000
VARIOGRAM_BINS = 20
VARIOGRAM_MIN_PAIRS = 20
VARIOGRAM_MIN_BINS = 5
DISTANCE_QUANTILE = 0.90
SILL_QUANTILE = 0.95
SILL_SHARE = 0.9
SHAPES = ("square", "hexagon")


def replicate_seed(seed: int, replicate: int) -> int:
    """All algorithms of a replicate share its folds."""
    return seed + REPLICATE_STRIDE * replicate


def _shuffled(df: DataFrame, ident: str, seed: int, by) -> DataFrame:
    """``_o``: position of each row in a seeded shuffle of its group, ``_n``: group size."""
    return shuffled(df, ident, seed, by=by, name="_o", total="_n")


def split_holdout(df: DataFrame, ident: str, label: str | None = None,
                  test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED, keys=()) -> DataFrame:
    """``is_test`` for a random hold-out, per class when ``label`` is given."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie between 0 and 1")
    keys = key_list(keys)
    by = [*keys, label] if label else keys
    share = F.bround(F.col("_n") * F.lit(float(test_size)))
    if label is None:
        return (_shuffled(df, ident, seed, by)
                .withColumn("is_test", F.col("_o") < F.greatest(F.lit(1), share)).drop("_o", "_n"))
    # When every class rounds down to nothing, the first row by id is held out instead.
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(ident).alias("_i"))
    lone = sizes.groupBy(*keys).agg(F.sum(share).alias("_tests"), F.min("_i").alias("_first"))
    rows = attach(_shuffled(df, ident, seed, by), lone, keys)
    test = (F.col("_o") < share) | ((F.col("_tests") == 0) & (F.col(ident) == F.col("_first")))
    return rows.withColumn("is_test", test).drop("_o", "_n", "_tests", "_first")


def split_kfold(df: DataFrame, ident: str, label: str | None = None, k: int = DEFAULT_K,
                seed: int = DEFAULT_SEED, keys=()) -> DataFrame:
    """``fold`` of near-equal sizes (the first n mod k folds get one more), per class if given."""
    if k < 2:
        raise ValueError("k must be at least 2")
    keys = key_list(keys)
    rows = _shuffled(df, ident, seed, [*keys, label] if label else keys)
    base, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    head = extra * (base + 1)
    fold = F.when(F.col("_o") < head, F.floor(F.col("_o") / (base + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("_o") - head, base)))
    return rows.withColumn("fold", fold.cast("int")).drop("_o", "_n")


def square_counts(grid: Grid, size: float) -> tuple[int, int]:
    return (max(1, math.ceil((grid.maxx - grid.minx) / size)),
            max(1, math.ceil((grid.maxy - grid.miny) / size)))


def blocks_square(df: DataFrame, grid: Grid, size: float) -> DataFrame:
    """``block_id`` and block centre on a square tiling anchored at the grid's lower left."""
    if size <= 0:
        raise ValueError("block size must be positive")
    nx, ny = square_counts(grid, size)

    def index(col: str, low: float, n: int) -> Column:
        step = (F.col(col) - F.lit(grid_low[col])) / F.lit(float(size))
        return F.least(F.lit(n - 1), F.greatest(F.lit(low), F.floor(step)))

    grid_low = {"x": grid.minx, "y": grid.miny}
    bx, by = index("x", 0, nx), index("y", 0, ny)
    return df.withColumns({
        "block_id": (by * nx + bx).cast("bigint"),
        "block_x": F.lit(grid.minx) + (bx + 0.5) * size,
        "block_y": F.lit(grid.miny) + (by + 0.5) * size})


def hex_radius(size: float) -> float:
    """Centre-to-corner distance of the hexagon with the area of a ``size`` x ``size`` square."""
    return size / math.sqrt(1.5 * math.sqrt(3.0))


def with_hexagon(df: DataFrame, size: float) -> DataFrame:
    """Axial coordinates ``hex_q``, ``hex_r`` of the flat-top hexagon under each point."""
    radius, root3 = hex_radius(size), math.sqrt(3.0)
    q = F.col("x") * (2.0 / 3.0) / radius
    r = (F.col("y") * (root3 / 3.0) - F.col("x") * (1.0 / 3.0)) / radius
    s = -q - r
    cube = df.withColumns({"_q": q, "_r": r, "_s": s}).withColumns(
        {"_rq": F.rint("_q"), "_rr": F.rint("_r"), "_rs": F.rint("_s")}).withColumns(
        {"_dq": F.abs(F.col("_rq") - F.col("_q")), "_dr": F.abs(F.col("_rr") - F.col("_r")),
         "_ds": F.abs(F.col("_rs") - F.col("_s"))})
    # The coordinate that was rounded the furthest is recomputed from the other two.
    q_worst = (F.col("_dq") > F.col("_ds")) & (F.col("_dq") > F.col("_dr"))
    s_worst = ~q_worst & (F.col("_ds") > F.col("_dr"))
    return cube.withColumns({
        "hex_q": F.when(q_worst, -F.col("_rs") - F.col("_rr")).otherwise(F.col("_rq")).cast("bigint"),
        "hex_r": F.when(~q_worst & ~s_worst, -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr")).cast("bigint"),
    }).drop("_q", "_r", "_s", "_rq", "_rr", "_rs", "_dq", "_dr", "_ds")


def blocks_hex(df: DataFrame, size: float, keys=()) -> DataFrame:
    """``block_id`` (dense over occupied hexagons by q, r) and centre on an equal-area tiling."""
    if size <= 0:
        raise ValueError("block size must be positive")
    keys = key_list(keys)
    placed = with_hexagon(df, size)
    tiles = placed.select(*keys, "hex_q", "hex_r").distinct()
    numbered = ordinal(tiles, ["hex_q", "hex_r"], F.col("hex_q"), keys, "block_id")
    radius = hex_radius(size)
    return lookup(placed, numbered, [*keys, "hex_q", "hex_r"]).withColumns({
        "block_x": F.col("hex_q") * (1.5 * radius),
        "block_y": (F.col("hex_q") * (math.sqrt(3.0) / 2) + F.col("hex_r") * math.sqrt(3.0)) * radius,
    }).drop("hex_q", "hex_r")


def block_folds(blocked: DataFrame, k: int = DEFAULT_K, seed: int = DEFAULT_SEED, keys=()) -> DataFrame:
    """one row per occupied block with its fold: shuffled blocks dealt out in turn."""
    if k < 2:
        raise ValueError("k must be at least 2")
    keys = key_list(keys)
    blocks = blocked.groupBy(*keys, "block_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("block_x").alias("block_x"), F.min("block_y").alias("block_y"))
    return (_shuffled(blocks, "block_id", seed, keys)
            .withColumn("fold", (F.col("_o") % k).cast("int")).drop("_o", "_n"))


def block_corners(folds: DataFrame, size: float, shape: str = "square") -> DataFrame:
    """F8: corner points of each block, in order, for drawing."""
    if shape == "hexagon":
        radius = hex_radius(size)
        ring = [(radius * math.cos(math.radians(60 * i)), radius * math.sin(math.radians(60 * i)))
                for i in range(6)]
    else:
        h = size / 2.0
        ring = [(-h, -h), (h, -h), (h, h), (-h, h)]
    corners = [F.struct((F.col("block_x") + dx).alias("x"), (F.col("block_y") + dy).alias("y"))
               for dx, dy in ring]
    return folds.withColumn("corners", F.array(*corners))


def with_blocks(df: DataFrame, grid: Grid, size: float, shape: str = "square", keys=()) -> DataFrame:
    if shape not in SHAPES:
        raise ValueError(f"block shape must be one of {SHAPES}")
    return blocks_hex(df, size, keys) if shape == "hexagon" else blocks_square(df, grid, size)


def split_blocks(df: DataFrame, cells: DataFrame, grid: Grid, k: int = DEFAULT_K,
                 block_size: float | None = None, shape: str = "square", predictor: str | None = None,
                 seed: int = DEFAULT_SEED, keys=()) -> DataFrame:
    """Spatial block folds; the block size is estimated when not given."""
    if block_size is None:
        if predictor is None:
            raise ValueError("estimating the block size needs a predictor")
        block_size = auto_block_size(cells, grid, predictor, seed).first().block_size
    keys = key_list(keys)
    blocked = with_blocks(df, grid, block_size, shape, keys)
    folds = block_folds(blocked, k, seed, keys).select(*keys, "block_id", "fold")
    return lookup(blocked, folds, [*keys, "block_id"]).drop("block_x", "block_y")


def _variogram_pairs(cells: DataFrame, grid: Grid, predictor: str, seed: int) -> DataFrame:
    """Hashed sample locations with a value, and hashed pairs of them: distance and semivariance."""
    spark = cells.sparkSession
    drawn = spark.range(VARIOGRAM_SAMPLES).select(
        F.col("id").alias("i"),
        (F.lit(grid.minx) + hash_uniform(seed, "variogram", F.col("id"), "x") * (grid.maxx - grid.minx)).alias("x"),
        (F.lit(grid.miny) + hash_uniform(seed, "variogram", F.col("id"), "y") * (grid.maxy - grid.miny)).alias("y"))
    seen = extract(with_cell(drawn, grid), cells, [predictor]).where(finite(predictor))
    sample = seen.select((F.row_number().over(W.orderBy("i")) - 1).alias("k"), "x", "y",
                         F.col(predictor).alias("v"))  # at most VARIOGRAM_SAMPLES rows
    size = sample.agg(F.count(F.lit(1)).alias("n_valid"))
    pairs = attach(spark.range(VARIOGRAM_PAIRS).select(F.col("id").alias("pair")), size, ()).select(
        "n_valid",
        F.floor(hash_uniform(seed, "pair", F.col("pair"), "a") * F.col("n_valid")).alias("ka"),
        F.floor(hash_uniform(seed, "pair", F.col("pair"), "b") * F.col("n_valid")).alias("kb")).where("ka <> kb")
    a = sample.select(F.col("k").alias("ka"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("v").alias("va"))
    b = sample.select(F.col("k").alias("kb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("v").alias("vb"))
    both = pairs.join(F.broadcast(a), "ka").join(F.broadcast(b), "kb")
    dx, dy, dv = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"), F.col("va") - F.col("vb")
    return both.select("n_valid", F.sqrt(dx * dx + dy * dy).alias("d"), (dv * dv * 0.5).alias("gamma"))


def variogram(cells: DataFrame, grid: Grid, predictor: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """mean semivariance per distance bin (bins with too few pairs are left out)."""
    pairs = _variogram_pairs(cells, grid, predictor, seed)
    span = pairs.agg(F.percentile("d", DISTANCE_QUANTILE).alias("max_d"))
    step = F.col("max_d") / F.lit(float(VARIOGRAM_BINS))
    binned = attach(pairs, span, ()).where("max_d > 0").withColumn(
        "bin", F.floor(F.col("d") / step).cast("int")).where(F.col("bin") < VARIOGRAM_BINS)
    return (binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("gamma").alias("gamma"),
        F.max((F.col("bin") + 0.5) * step).alias("distance"), F.max("n_valid").alias("n_valid"))
        .where(F.col("n_pairs") > VARIOGRAM_MIN_PAIRS))


def auto_block_size(cells: DataFrame, grid: Grid, predictor: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """one row ``block_size``, ``source``: the distance where the variogram levels off.

    Falls back to a twentieth of the shorter side when the variogram is not usable.
    """
    side = grid.shorter_side
    fallback = side / 20.0
    bins = variogram(cells, grid, predictor, seed)
    shape = bins.agg(F.count(F.lit(1)).alias("n_bins"), F.percentile("gamma", SILL_QUANTILE).alias("sill"))
    level = attach(bins, shape, ()).where(F.col("gamma") >= F.col("sill") * SILL_SHARE).agg(
        F.min("distance").alias("distance"), F.max("n_bins").alias("n_bins"),
        F.max("sill").alias("sill"), F.max("n_valid").alias("n_valid"))
    usable = F.coalesce((F.col("n_valid") >= VARIOGRAM_MIN_VALID) & (F.col("n_bins") >= VARIOGRAM_MIN_BINS)
                        & (F.col("sill") > 0), F.lit(False))
    clamped = F.least(F.lit(side / 3.0), F.greatest(F.lit(fallback / 4.0), F.col("distance")))
    return level.select(F.when(usable, clamped).otherwise(F.lit(fallback)).alias("block_size"),
                        F.when(usable, "auto_variogram").otherwise(F.lit("auto_fallback")).alias("source"))


def fold_summary(df: DataFrame, fold: str = "fold", label: str = "label", keys=()) -> DataFrame:
    """test and train sizes with class balance per fold; folds with an empty side are dropped."""
    keys = key_list(keys)
    per = df.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n_test"),
                                      F.count_if(F.col(label) == 1).alias("presences_test"))
    every = per.groupBy(*keys).agg(F.sum("n_test").alias("_n"), F.sum("presences_test").alias("_p"))
    return attach(per, every, keys).select(
        *keys, fold, (F.col("_n") - F.col("n_test")).alias("n_train"), "n_test",
        (F.col("_p") - F.col("presences_test")).alias("presences_train"), "presences_test",
    ).where("n_train > 0")
