import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nichefield import Grid  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def grid():
    return Grid(0.0, 40.0, 1.0, 1.0, 40, 40, "EPSG:32633")


@pytest.fixture(scope="session")
def cells(spark, grid):
    """40 x 40 cells: a gradient, an oscillation and a hashed noise layer."""
    rc = spark.range(1600).select(F.floor(F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"))
    return rc.select("row", "col", (F.col("col") + 0.5).alias("x"), (40 - (F.col("row") + 0.5)).alias("y"),
                     ((F.col("col") + F.col("row")) / 80).alias("band_0"),
                     (F.sin(F.col("col") / 5) + F.cos(F.col("row") / 5)).alias("band_1"),
                     (F.pmod(F.xxhash64("row", "col"), F.lit(1000)) / 1000).alias("band_2")).cache()
