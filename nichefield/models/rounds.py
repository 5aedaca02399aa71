"""Fits that take their sums over all rows in rounds: rows are packed once, each round is one pass over the packs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLLECTED = 1_000_000  # numbers that all tasks of a round together send to the driver, beyond that they are summed in tasks first


def packed(rows: DataFrame, columns) -> DataFrame:
    """``columns`` as packs of numbers, a pack per Arrow batch: 8 bytes a value, and no row is built again in a round."""
    columns = list(columns)

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"pack": [np.ascontiguousarray(pdf[columns].to_numpy(float)).tobytes()]})

    return rows.select(*columns).mapInPandas(pack, "pack binary")


def share_of(packs: DataFrame, width: int, share: int) -> DataFrame:
    """One in ``share`` rows, told by their values alone, so that it does not depend on how rows were packed."""
    odd = np.random.default_rng(width).integers(1, 2**62, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keep(batches):
        for pdf in batches:
            for pack in pdf["pack"]:
                x = np.frombuffer(pack).reshape(-1, width)
                mixed = ((x + 0.0).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * odd[0]
                some = x[(mixed >> np.uint64(33)) % np.uint64(share) == 0]
                if len(some):
                    yield pd.DataFrame({"pack": [some.tobytes()]})

    return packs.mapInPandas(keep, "pack binary")


def summed(packs: DataFrame, width: int, size: int, sums) -> np.ndarray:
    """Total of ``sums(rows)``, ``size`` numbers, over all packs of ``width`` columns: per task, then over tasks in their order.

    Totals of few tasks go to the driver as they are, those of many meet entry by entry in tasks first."""
    def totals(batches):
        total = np.zeros(size)
        for pdf in batches:
            for pack in pdf["pack"]:
                total += sums(np.frombuffer(pack).reshape(-1, width))
        return total

    def whole(batches):
        yield pd.DataFrame({"v": [totals(batches).tobytes()]})

    def by_entry(batches):
        yield pd.DataFrame({"i": np.arange(size), "v": totals(batches)})

    if packs.rdd.getNumPartitions() * size <= COLLECTED:
        return np.sum([np.frombuffer(r.v) for r in packs.mapInPandas(whole, "v binary").collect()], axis=0)
    flat = np.zeros(size)
    for r in packs.mapInPandas(by_entry, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r.i] = r.v
    return flat
