"""Background and pseudo-absence sampling.

Candidate ``i`` of a seed has fixed hashed coordinates, so a sample is "the first n acceptable
candidates": the same on every run and every cluster. Candidates are drawn in one pass sized from
the share of usable cells; a shortfall draws the next stretch of the same sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import is_geographic, meters_per_degree, meters_per_degree_value
from ..functions.hashing import hash_uniform
from ..functions.scalars import all_finite, complete_rows, finite, with_cell
from ..grid import DEFAULT_SEED, Grid
from .cells import extract
from .common import attach, checkpointed, key_list, ordinal
from .nearby import in_distance_band
from .quantiles import quantiles

# Default counts, and how many candidates per wanted point are tried at most.
DEFAULT_COUNT = 10_000
DEFAULT_RATIO = 4.0
DEFAULT_QUANTILE = 0.025
DEFAULT_MAX_METERS = 50_000.0
BLOCK = 1024  # candidates expanded per row, so one request never sits in one task


@dataclass(frozen=True)
class Budget:
    """Candidates tried at most for ``n`` wanted points: ``rounds * max(factor * n, least)``."""

    rounds: int
    factor: int
    least: int

    def tries(self, n: Column) -> Column:
        return (self.rounds * F.greatest(self.factor * n, F.lit(self.least))).cast("bigint")


# The budgets by kind of method. Each sampler takes another one as an argument.
UNIFORM_BUDGET = Budget(20, 3, 1000)
SEARCH_BUDGET = Budget(30, 5, 2000)  # where only some places qualify: disk, buffer, envelope


def background_count(occ: DataFrame, method: str = "random", count: int = DEFAULT_COUNT,
                     ratio: float = DEFAULT_RATIO, keys=()) -> DataFrame:
    """Points to draw: a fixed count, or ``ratio`` per presence rounded half up (at least 1)."""
    if method == "ratio":
        if ratio <= 0:
            raise ValueError("ratio must be greater than zero")
        n = F.greatest(F.lit(1), F.floor(F.col("n_presence") * F.lit(float(ratio)) + 0.5))
    else:
        n = F.lit(int(count))
    return (occ.groupBy(*key_list(keys)).agg(F.count_if(F.col("presence") == 1).alias("n_presence"))
            .withColumn("n", n.cast("bigint")))


def _wanted(spark, n, keys) -> DataFrame:
    """Requests as a table: ``keys`` and ``n``; a plain number is one request."""
    if isinstance(n, DataFrame):
        return n.select(*keys, F.col("n").cast("bigint").alias("n"))
    return spark.range(1).select(F.lit(int(n)).cast("bigint").alias("n"))


def candidates(wanted: DataFrame, box, seed: int, start: Column, stop: Column, keys=()) -> DataFrame:
    """Candidates ``start <= i < stop`` of each request, uniform over ``box``.

    Requests expand in two steps with a shuffle in between, so ten million candidates of one
    species are spread over the cluster instead of coming out of one row.
    """
    x0, y0, x1, y1 = (F.lit(float(v)) if not isinstance(v, Column) else v for v in box)
    names = [c for c in wanted.columns]
    blocks = wanted.withColumns({"_from": start, "_to": stop}).where("_to > _from").withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_from") / BLOCK),
                                       F.floor((F.col("_to") - 1) / BLOCK))))
    ids = (blocks.repartition(*keys, "_block")
           .withColumn("i", F.explode(F.sequence(F.col("_block") * BLOCK, F.col("_block") * BLOCK + BLOCK - 1)))
           .where("i >= _from and i < _to"))
    label = [F.col(k) for k in keys]
    return ids.select(*names, "i",
                      (x0 + hash_uniform(seed, *label, F.col("i"), "x") * (x1 - x0)).alias("x"),
                      (y0 + hash_uniform(seed, *label, F.col("i"), "y") * (y1 - y0)).alias("y"))


def _first_n(accepted: DataFrame, keys) -> DataFrame:
    """The first ``n`` accepted candidates by id, numbered without a global sort."""
    ranked = ordinal(accepted, ["i"], F.floor(F.col("i") / (64 * BLOCK)), keys)
    return ranked.where(F.col("ordinal") < F.col("n")).drop("ordinal")


def _sample(wanted: DataFrame, keys, seed: int, box, share: float, accept, tries: Budget) -> DataFrame:
    """Draw until every request is filled or the try budget is spent; may return fewer.

    The first stretch is sized from the share of usable cells, later ones from the acceptance
    seen so far. Stretches only decide how the sequence is cut, never what is accepted.
    """
    share = min(1.0, max(share, 1.0 / (tries.rounds * tries.factor)))
    budget = tries.tries(F.col("n"))
    stretch = F.ceil(F.greatest(F.lit(tries.least), F.col("n") * F.lit(1.2 / share))).cast("bigint")
    state = wanted.withColumns({"_done": F.lit(0).cast("bigint"), "_upto": F.least(budget, stretch)})
    found = None
    while True:
        drawn = candidates(state, box, seed, F.col("_done"), F.col("_upto"), keys)
        more = checkpointed(accept(drawn).select(*keys, "n", "i", "x", "y"))
        found = more if found is None else found.unionByName(more)
        got = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_got"))
        if keys:
            state = state.join(got, keys, "left")
        else:
            state = state.withColumn("_got", got.select("_got").scalar())
        have = F.coalesce("_got", F.lit(0))
        short = state.where((have < F.col("n")) & (F.col("_upto") < budget))
        if short.isEmpty():
            return _first_n(found, keys).select(*keys, "i", "x", "y")
        need = F.ceil(F.col("n") * F.col("_upto") * 1.1 / F.greatest(have, F.lit(1))) + tries.least
        state = checkpointed(short.withColumns({"_done": F.col("_upto"), "_upto": F.least(budget, need.cast("bigint"))})
                             .drop("_got"))


def _usable_share(cells: DataFrame, grid: Grid, condition: Column) -> float:
    return cells.where(condition).count() / grid.n_cells


def _on_usable_cells(cells: DataFrame, grid: Grid, columns, test: Column):
    def accept(drawn: DataFrame) -> DataFrame:
        located = with_cell(drawn, grid)
        return extract(located, cells, columns).where(test).select(*drawn.columns)
    return accept


def background_random(cells: DataFrame, grid: Grid, n, predictors, seed: int = DEFAULT_SEED,
                      keys=(), budget: Budget = UNIFORM_BUDGET) -> DataFrame:
    """Uniform over the extent, kept where the first predictor has a value.

    ``n`` is a number, or a table of ``keys`` and ``n`` such as ``background_count`` returns.
    """
    keys, first = key_list(keys), predictors[0]
    share = _usable_share(cells, grid, finite(first))
    return _sample(_wanted(cells.sparkSession, n, keys), keys, seed, grid.bounds, share,
                   _on_usable_cells(cells, grid, [first], finite(first)), budget)


def background_disk(occ: DataFrame, cells: DataFrame, grid: Grid, n, predictors, min_m: float = 0.0,
                    max_m: float = DEFAULT_MAX_METERS, seed: int = DEFAULT_SEED, keys=(),
                    budget: Budget = SEARCH_BUDGET) -> DataFrame:
    """Nearest presence between ``min_m`` and ``max_m`` metres away (0 = no upper limit).

    On a grid in degrees, metres are converted at the mean latitude of the presences, each key's own with ``keys``.
    """
    keys = key_list(keys)
    if min_m < 0 or max_m < 0:
        raise ValueError("distances cannot be negative")
    if 0 < max_m <= min_m:
        raise ValueError("the minimum distance must be smaller than the maximum (0 = no maximum)")
    presences = occ.where(F.col("presence") == 1).select(*keys, "x", "y").where(finite("x") & finite("y"))
    px0, py0, px1, py1, lat = presences.agg(
        F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.avg("y")).first()
    if px0 is None:
        raise ValueError("distance-based background needs presences")
    degrees = bool(grid.crs) and is_geographic(grid.crs)
    per_unit = meters_per_degree_value(lat) if degrees else 1.0
    # A key at another latitude has its coordinates stretched, so that one radius in units serves all keys.
    stretch = None
    if keys and degrees:
        stretch = checkpointed(presences.groupBy(*keys).agg((meters_per_degree(F.avg("y")) / F.lit(per_unit)).alias("_s")))
    low, high = min_m / per_unit, max_m / per_unit
    wanted, box = _wanted(cells.sparkSession, n, keys), grid.bounds
    if high > 0:  # nothing beyond the presences' own box plus the outer radius can qualify
        box = (max(box[0], px0 - high), max(box[1], py0 - high),
               min(box[2], px1 + high), min(box[3], py1 + high))
        if stretch is None and (box[2] <= box[0] or box[3] <= box[1]):
            raise ValueError("the area around the presences lies outside the grid")
        if keys:  # one box per request, so a narrow-ranged species is not searched for everywhere
            far = F.lit(high) if stretch is None else F.lit(high) / F.first("_s")
            near = presences if stretch is None else attach(presences, stretch, keys)
            own = near.groupBy(*keys).agg(
                F.greatest(F.lit(grid.bounds[0]), F.min("x") - far).alias("_x0"),
                F.greatest(F.lit(grid.bounds[1]), F.min("y") - far).alias("_y0"),
                F.least(F.lit(grid.bounds[2]), F.max("x") + far).alias("_x1"),
                F.least(F.lit(grid.bounds[3]), F.max("y") + far).alias("_y1"))
            wanted = checkpointed(wanted.join(own, keys).where("_x1 > _x0 and _y1 > _y0"))
            box = tuple(F.col(c) for c in ("_x0", "_y0", "_x1", "_y1"))
    first = predictors[0]
    on_cell = _on_usable_cells(cells, grid, [first], finite(first))

    def accept(drawn: DataFrame) -> DataFrame:
        usable = checkpointed(on_cell(drawn))  # the cheap test first; read by each distance test
        if stretch is None:
            return in_distance_band(usable, presences, "i", low, high, keys)
        wide = {"x": F.col("x") * F.col("_s"), "y": F.col("y") * F.col("_s")}
        there = attach(usable, stretch, keys).withColumns({"_px": F.col("x"), "_py": F.col("y")}).withColumns(wide)
        known = attach(presences, stretch, keys).withColumns(wide).drop("_s")
        held = in_distance_band(there, known, "i", low, high, keys)
        return held.withColumns({"x": F.col("_px"), "y": F.col("_py")}).drop("_px", "_py", "_s")

    out = _sample(wanted, keys, seed, box, _usable_share(cells, grid, finite(first)), accept, budget)
    if out.isEmpty():
        raise ValueError("no location lies between the minimum and maximum distance from a presence")
    return out


def background_buffered(occ: DataFrame, cells: DataFrame, grid: Grid, n, predictors, dist_m: float,
                        seed: int = DEFAULT_SEED, keys=(), budget: Budget = SEARCH_BUDGET) -> DataFrame:
    """Any presence within one radius."""
    return background_disk(occ, cells, grid, n, predictors, 0.0, dist_m, seed, keys, budget)


def presence_envelope(values: DataFrame, predictors, q: float = DEFAULT_QUANTILE, keys=()) -> DataFrame:
    """Per predictor the ``q`` and ``1 - q`` quantiles over presences with every value."""
    if not 0.0 <= q < 0.5:
        raise ValueError("the quantile must be at least 0 and below 0.5")
    used = complete_rows(values.where(F.col("presence") == 1), predictors)
    ends = quantiles(used, predictors, [q, 1.0 - q], keys, count="n_used")
    bounds = [c for p in predictors for c in (F.col(p)[0].alias(f"{p}_low"), F.col(p)[1].alias(f"{p}_high"))]
    return ends.select(*key_list(keys), "n_used", *bounds)


def background_sre(occ: DataFrame, cells: DataFrame, grid: Grid, n, predictors,
                   q: float = DEFAULT_QUANTILE, seed: int = DEFAULT_SEED, keys=(),
                   budget: Budget = SEARCH_BUDGET) -> DataFrame:
    """Valid on every predictor and outside the presences' envelope on at least one."""
    keys = key_list(keys)
    at_presence = extract(with_cell(occ.where(F.col("presence") == 1), grid), cells, predictors)
    envelope = checkpointed(presence_envelope(at_presence, predictors, q, keys))
    if not envelope.where("n_used < 2").isEmpty() or envelope.isEmpty():
        raise ValueError("the envelope needs at least 2 presences with every predictor value")
    outside = F.lit(False)
    for p in predictors:
        outside = outside | (F.col(p) < F.col(f"{p}_low")) | (F.col(p) > F.col(f"{p}_high"))

    def accept(drawn: DataFrame) -> DataFrame:
        seen = extract(with_cell(drawn, grid), cells, predictors).where(all_finite(predictors))
        return attach(seen, envelope.drop("n_used"), keys).where(outside).select(*drawn.columns)

    out = _sample(_wanted(cells.sparkSession, n, keys), keys, seed, grid.bounds,
                  _usable_share(cells, grid, all_finite(predictors)), accept, budget)
    if out.isEmpty():
        raise ValueError("no location lies outside the presences' environmental envelope")
    return out


def label_points(occ: DataFrame, background: DataFrame | None, cells: DataFrame, grid: Grid, predictors,
                 mode: str = "presence_only", keys=()) -> DataFrame:
    """Labelled points with complete predictor values.

    Presence/absence data keep their labels. Presence-only data use the flagged rows (all rows
    when none is flagged) as presences and the background points as label 0.
    """
    keys = key_list(keys)
    if mode == "presence_absence":
        points = occ.select(*keys, F.concat(F.lit("o"), F.col("rid")).alias("pid"), "x", "y",
                            F.col("presence").cast("int").alias("label"))
    elif mode == "presence_only":
        flagged = occ.groupBy(*keys).agg((F.max("presence") > 0).alias("_flagged"))
        used = attach(occ, flagged, keys).where((F.col("presence") == 1) | ~F.col("_flagged"))
        points = used.select(*keys, F.concat(F.lit("o"), F.col("rid")).alias("pid"), "x", "y",
                             F.lit(1).alias("label"))
        if background is not None:
            points = points.unionByName(background.select(
                *keys, F.concat(F.lit("b"), F.col("i")).alias("pid"), "x", "y", F.lit(0).alias("label")))
    else:
        raise ValueError(f"unknown data mode {mode!r}")
    located = with_cell(points, grid)
    return complete_rows(extract(located, cells, predictors), predictors).select(
        *keys, "pid", "x", "y", "row", "col", "label", *predictors)


def shortfall(labelled: DataFrame, requested: DataFrame, keys=()) -> DataFrame:
    """Background points asked for, drawn with complete values, and missing."""
    keys = key_list(keys)
    drawn = labelled.groupBy(*keys).agg(F.count_if(F.col("label") == 0).alias("drawn"))
    asked = requested.select(*keys, F.col("n").alias("requested"))
    if keys:
        both = asked.join(drawn, keys, "left")
    else:
        both = asked.withColumn("drawn", drawn.select("drawn").scalar())
    both = both.withColumn("drawn", F.coalesce("drawn", F.lit(0)).cast("bigint"))
    return both.withColumn("missing", F.greatest(F.lit(0), F.col("requested") - F.col("drawn")))
