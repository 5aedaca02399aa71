"""Exact "is any presence within this distance?" without pairing points with points.

Presences are reduced to one row per occupied square with the bounding box of its points. A
candidate meets only the few occupied squares around it, and the nearest and farthest point of a
box usually settle the question. What stays open goes one level deeper, to squares a quarter as
wide. So a square holding a third of all presences is one row, never a third of all pairs.

Squares travel in packs: those in and around a tile of 4 x 4 at first, the 4 x 4 of an open square
on deeper levels. A candidate is one row that meets one pack, so it is not copied for its neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, at_most, checkpointed, key_list

FAN_OUT = 4  # each level splits a square into FAN_OUT x FAN_OUT; a tile has as many
REACH = 2  # squares just over half the radius: two on each side cover the circle
MAX_LEVELS = 24


def _squares(points: DataFrame, size: float, keys) -> DataFrame:
    """Occupied squares of one level with the bounding box of their points."""
    return (points.withColumns({"_qx": F.floor(F.col("x") / size), "_qy": F.floor(F.col("y") / size)})
            .groupBy(*keys, "_qx", "_qy")
            .agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                 F.min("y").alias("y0"), F.max("y").alias("y1")))


def _packs(squares: DataFrame, margin: int, keys) -> DataFrame:
    """The squares of each tile (``_tx``, ``_ty``) and ``margin`` squares around it: at most (FAN_OUT + 2 margin) ** 2."""
    tiles = lambda q: F.explode(F.sequence(F.floor((F.col(q) - margin) / FAN_OUT), F.floor((F.col(q) + margin) / FAN_OUT)))
    placed = squares.select(*keys, tiles("_qx").alias("_tx"), "_qy", F.struct("_qx", "_qy", "x0", "x1", "y0", "y1").alias("_box"))
    return (placed.select(*keys, "_tx", tiles("_qy").alias("_ty"), "_box")
            .groupBy(*keys, "_tx", "_ty").agg(F.collect_list("_box").alias("_boxes")))


def _nearest(b: Column) -> Column:
    """Squared distance from (x, y) to the nearest corner or edge of the box."""
    x, y, zero = F.col("x"), F.col("y"), F.lit(0.0)
    dx, dy = F.greatest(b.x0 - x, zero, x - b.x1), F.greatest(b.y0 - y, zero, y - b.y1)
    return dx * dx + dy * dy


def _farthest(b: Column) -> Column:
    x, y = F.col("x"), F.col("y")
    dx, dy = F.greatest(F.abs(x - b.x0), F.abs(x - b.x1)), F.greatest(F.abs(y - b.y0), F.abs(y - b.y1))
    return dx * dx + dy * dy


def ids_within(candidates: DataFrame, presences: DataFrame, radius: float, cand_id: str,
               inclusive: bool = True, keys=()) -> DataFrame:
    """Keys and ids of candidates with at least one presence within ``radius`` (``<`` or ``<=``).

    A box whose farthest point is in reach settles "yes" only if it holds a point, which every
    listed box does; a box whose nearest point is out of reach is dropped.
    """
    keys = key_list(keys)
    limit = F.lit(float(radius) * float(radius))
    inside = (lambda d: d <= limit) if inclusive else (lambda d: d < limit)
    size = radius / 2.0 * (1.0 + 1e-9)
    points = checkpointed(presences.select(*keys, "x", "y").distinct())
    # A pack holds few squares and a square is in four packs on average, so one check covers every level's join.
    small, on = at_most(points, BROADCAST_ROWS // 4), [*keys, "_tx", "_ty"]
    tile = lambda c: F.floor(F.floor(F.col(c) / size) / FAN_OUT)
    pairs = candidates.select(*keys, cand_id, "x", "y", tile("x").alias("_tx"), tile("y").alias("_ty"))
    found, margin = None, REACH
    for _ in range(MAX_LEVELS):
        packs = _packs(_squares(points, size, keys), margin, keys)
        met = pairs.join(F.broadcast(packs) if small else packs, on)
        hit = F.exists("_boxes", lambda b: inside(_farthest(b)))
        # A box that is a single point is settled: nearest and farthest coincide.
        left = F.filter("_boxes", lambda b: inside(_nearest(b)) & ((b.x0 < b.x1) | (b.y0 < b.y1)))
        left = F.transform(left, lambda b: F.struct(b._qx.alias("_tx"), b._qy.alias("_ty")))
        judged = met.select(*keys, cand_id, "x", "y", hit.alias("_hit"), "_boxes")
        judged = judged.select(*keys, cand_id, "x", "y", "_hit", F.when(~F.col("_hit"), left).alias("_left"))
        judged = checkpointed(judged.where(F.col("_hit") | (F.size("_left") > 0)))
        hits = judged.where("_hit").select(*keys, cand_id).distinct()
        found = hits if found is None else found.unionByName(hits).distinct()
        still_open = judged.where(~F.col("_hit")).join(hits, [*keys, cand_id], "left_anti")
        if still_open.isEmpty():
            return found
        size /= FAN_OUT
        # The squares of the next level in an open square are those of the tile that it is.
        pairs = still_open.select(*keys, cand_id, "x", "y", F.explode("_left").alias("_o")).select(*keys, cand_id, "x", "y", "_o.*")
        margin = 0
    # Only points closer together than the radius / 4**24 are left: compare them directly.
    d2 = (F.col("x") - F.col("_px")) ** 2 + (F.col("y") - F.col("_py")) ** 2
    at = lambda c: F.floor(F.floor(F.col(c) / size) / FAN_OUT)
    last = points.select(*keys, F.col("x").alias("_px"), F.col("y").alias("_py"), at("x").alias("_tx"), at("y").alias("_ty"))
    tail = pairs.join(last, on).where(inside(d2)).select(*keys, cand_id).distinct()
    return found.unionByName(tail).distinct()


def in_distance_band(candidates: DataFrame, presences: DataFrame, cand_id: str, min_distance: float,
                     max_distance: float, keys=()) -> DataFrame:
    """Candidates whose nearest presence is at least ``min`` and at most ``max`` away (0 = no limit)."""
    if min_distance < 0 or max_distance < 0:
        raise ValueError("distances cannot be negative")
    if 0 < max_distance <= min_distance or not math.isfinite(min_distance):
        raise ValueError("the minimum distance must be smaller than the maximum (0 = no maximum)")
    keys = key_list(keys)
    on = [*keys, cand_id]
    out = candidates
    if max_distance > 0:
        out = out.join(ids_within(candidates, presences, max_distance, cand_id, True, keys), on, "left_semi")
        out = checkpointed(out) if min_distance > 0 else out  # read again below
    if min_distance > 0:
        out = out.join(ids_within(out, presences, min_distance, cand_id, False, keys), on, "left_anti")
    return out
