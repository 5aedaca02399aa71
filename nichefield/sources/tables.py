"""Surfaces and run tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_number
from ..grid import FLOAT_NODATA, Grid
from ..operators.cells import surface_encoded
from ..operators.common import checkpointed, key_list


def write_surface(df: DataFrame, path: str, grid: Grid, value: str = "value", dtype: str = "float32",
                  nodata: float = FLOAT_NODATA, keys=(), mode: str = "errorifexists") -> None:
    """Store a surface as Parquet, range-clustered by row and column within each key.

    Every key must cover the grid exactly; existing output is refused unless asked otherwise.
    """
    keys = key_list(keys)
    surface = checkpointed(df)  # checked and written from one evaluation
    cell = F.when(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1), F.col("row") * F.lit(grid.width).cast("bigint") + F.col("col"))
    each = surface.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    seen = each.groupBy(*keys).agg(F.count("_cell").alias("cells"), F.sum("_n").alias("rows"))
    wrong = seen.where((F.col("cells") != grid.n_cells) | (F.col("rows") != grid.n_cells))
    if not wrong.isEmpty():
        raise ValueError(f"the surface does not cover the {grid.height} x {grid.width} grid")
    out = surface_encoded(surface, value, dtype, nodata).repartitionByRange(*keys, "row", "col")
    writer = out.sortWithinPartitions(*keys, "row", "col").write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def read_surface(spark: SparkSession, path: str, value: str = "value", nodata: float = FLOAT_NODATA) -> DataFrame:
    df = spark.read.parquet(path)
    number = F.col(value).cast("double")
    return df.withColumn(value, F.when(number != nodata, clean_number(number)))


def write_table(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Run tables (metrics, selection steps, parameters) as JSON, CSV or Parquet."""
    if fmt not in ("json", "parquet", "csv"):
        raise ValueError(f"unknown table format {fmt!r}")
    df.write.mode(mode).format(fmt).save(path)
