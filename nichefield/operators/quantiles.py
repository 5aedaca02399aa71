"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import clean_number
from .common import at_most, checkpointed, join_on, key_list, range_parts

# Up to this many rows the built-in aggregate may hold all values of a group in one task.
IN_TASK_ROWS = 1_000_000


def quantiles(df: DataFrame, cols, probs, keys=(), count: str | None = None,
              in_task_rows: int = IN_TASK_ROWS) -> DataFrame:
    """Per key and column the quantiles ``probs`` (linear between ranks) as an array column.

    Small inputs use the built-in exact aggregate. Larger ones are ranked across the cluster:
    distinct values with counts are range-partitioned, and only the parts that hold a wanted rank
    are looked into.
    """
    keys, cols, probs = key_list(keys), list(cols), [float(p) for p in probs]
    rows = df.select(*keys, *cols)
    number = F.count(F.lit(1)).alias(count or "_n")
    if at_most(rows, in_task_rows):
        wanted = F.array(*[F.lit(p) for p in probs])
        out = rows.groupBy(*keys).agg(number, *[F.percentile(clean_number(c), wanted).alias(c) for c in cols])
        return out if count else out.drop("_n")
    found = _ranked(rows, cols, probs, keys)
    wide = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_f") == c, F.col("_q"))).alias(c) for c in cols])
    if keys:  # every group keeps its row, null keys and groups without a value included
        out = join_on(rows.groupBy(*keys).agg(number), wide, keys, "left")
        return out if count else out.drop("_n")
    return wide.withColumn(count, rows.select(number).scalar()) if count else wide


def _ranked(rows: DataFrame, cols, probs, keys) -> DataFrame:
    by = [*keys, "_f"]
    long = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("f"), clean_number(c).cast("double").alias("v")) for c in cols])).alias("_e"))
    values = (long.where("_e.v is not null")
              .groupBy(*keys, F.col("_e.f").alias("_f"), F.col("_e.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    parts = checkpointed(range_parts(values, [*by, "_v"]))  # one evaluation fixes the boundaries
    sizes = parts.groupBy(*by, "_part").agg(F.sum("_c").alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumns({"_off": F.coalesce(F.sum("_size").over(earlier), F.lit(0)),
                                "_total": F.sum("_size").over(W.partitionBy(*by))})
    position = (F.col("_total") - 1) * F.col("_p")
    ranks = placed.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in probs]))).withColumns(
        {"_lo": F.floor(position), "_hi": F.ceil(position), "_w": position - F.floor(position)})
    ranks = ranks.where("(_lo >= _off and _lo < _off + _size) or (_hi >= _off and _hi < _off + _size)")
    wanted = join_on(placed.select(*by, "_part", "_off"), ranks.select(*by, "_part").distinct(), [*by, "_part"])
    hit = join_on(parts, wanted, [*by, "_part"])
    upto = F.sum("_c").over(W.partitionBy(*by, "_part").orderBy("_v")) + F.col("_off")
    spans = hit.withColumn("_end", upto).select(*by, "_part", "_v", (F.col("_end") - F.col("_c")).alias("_start"), "_end")
    both = join_on(spans, ranks.select(*by, "_part", "_p", "_lo", "_hi", "_w"), [*by, "_part"])

    def at(rank: str):
        return F.max(F.when((F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end")), F.col("_v")))

    per = both.groupBy(*by, "_p").agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max("_w").alias("_w"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")
    got = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_p", value.alias("q")))).alias("_m"))
    return got.select(*by, F.array(*[F.col("_m")[F.lit(p)] for p in probs]).alias("_q"))
