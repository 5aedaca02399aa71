"""Shared physical helpers: exact numbering, range buckets, size-checked broadcasts, checkpoints."""

from __future__ import annotations

import tempfile
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import hash_order, order_bucket

# A side with at most this many rows may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 1_000_000


def key_list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or ())


def plain_key(key) -> tuple:
    """A group's key with every missing value as None, so that a null key finds its own records."""
    return tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))


def groups_of(pdf: pd.DataFrame, keys):
    """(key, positions) of each group of a batch, null keys included."""
    if not keys:
        return [((), np.arange(len(pdf)))]
    number = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    firsts = pdf[keys].iloc[np.unique(number, return_index=True)[1]]
    return [(plain_key(tuple(k)), np.flatnonzero(number == i)) for i, k in enumerate(firsts.itertuples(index=False, name=None))]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows, by a count that is combined on the map side."""
    return df.count() <= rows


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's, or a fresh local one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and cut its lineage there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner", small: bool = False) -> DataFrame:
    """Null-safe equi-join on ``keys``; ``small`` broadcasts ``right``, whose size the caller has checked.

    A plain join adds "key is not null" filters to one branch only, after which two branches of the
    same table no longer share their exchange. Null-safe equality adds none, and keeps null keys.
    """
    names = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(F.broadcast(renamed) if small else renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def lookup(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table with one row per ``on`` to a large one.

    A few weights or blocks are broadcast once a count shows they are few: shuffling the
    large side on a handful of keys would pile it up in as many tasks. More rows than that mean
    enough keys for a shuffle join, where AQE splits the hot ones. The small table is
    checkpointed, so that counting it does not compute it twice.
    """
    small = checkpointed(small)
    return big.join(F.broadcast(small) if at_most(small, rows) else small, on, how)


def attach(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Add per-key statistics to each row; without keys ``stats`` has a single row.

    The single row travels as a scalar subquery, so no join runs at all. With keys the statistics
    are computed once and broadcast when they are few, so that a large table with a handful of keys
    is not shuffled on them; many keys shuffle.
    """
    keys = key_list(keys)
    if keys:
        stats = checkpointed(stats)
        return join_on(df, stats, keys, small=at_most(stats, BROADCAST_ROWS))
    names = stats.columns
    row = stats.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("_stats", row).select(
        *df.columns, *[F.col("_stats")[n].alias(n) for n in names])


def ordinal(df: DataFrame, order_by, bucket: Column, by=(), name: str = "ordinal",
            total: str | None = None) -> DataFrame:
    """Exact 0-based row number within ``by``, without sorting a whole group in one task.

    ``bucket`` must not decrease along ``order_by``. Rows are numbered inside (by, bucket) and
    shifted by the sizes of the earlier buckets, so even a single huge group is spread out.
    """
    by = key_list(by)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    sliced = df.withColumn("_b", bucket)
    numbered = sliced.withColumn(
        "_r", F.row_number().over(W.partitionBy(*by, "_b").orderBy(*order)).cast("bigint"))
    # Bucket sizes are counted on the map side: a handful of rows per task, not a second sort.
    sizes = sliced.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_size").over(W.partitionBy(*by)))
    out = join_on(numbered, offsets.drop("_size"), [*by, "_b"])
    return out.withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def shuffled(df: DataFrame, ident: str, *seed, by=(), name: str = "ordinal", total: str | None = None) -> DataFrame:
    """Exact position of each row in a seeded shuffle of its group (ties by ``ident``)."""
    keyed = df.withColumn("_h", hash_order(*seed, F.col(ident)))
    bucket = order_bucket(F.col("_h"), shuffle_width(df.sparkSession) * 8)
    return ordinal(keyed, ["_h", ident], bucket, by, name, total).drop("_h")


def range_parts(df: DataFrame, cols) -> DataFrame:
    """Sort-range partition ``df`` on ``cols`` and tag each row with its partition in ``_part``.

    Sampling picks the boundaries, so clustered values are spread evenly. ``_part`` increases with
    ``cols`` and each consumer must read the tag from one evaluation of this plan.
    """
    n = shuffle_width(df.sparkSession)
    return df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id())
