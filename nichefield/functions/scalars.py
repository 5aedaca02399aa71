"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid

MIN_SPREAD = 1e-12  # a standard deviation below this counts as constant


def finite(col) -> Column:
    """True for a usable number: not NULL, not NaN, not infinite."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c * 0.0 == 0.0, F.lit(False))  # one mention of the input keeps plans small


def clean_number(col) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(finite(c), c)


def not_nan(col) -> Column:
    return F.nanvl(col, F.lit(None).cast("double"))


def all_finite(cols) -> Column:
    return reduce(lambda a, b: a & b, [finite(c) for c in cols], F.lit(True))


def with_cell(df: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Row and column of the grid cell under each point (negative or past the edge off-grid)."""
    gx = F.floor((not_nan(x) - F.lit(grid.minx)) / F.lit(grid.res_x))
    gy = F.floor((F.lit(grid.maxy) - not_nan(y)) / F.lit(grid.res_y))
    return df.withColumns({"row": gy, "col": gx})


def complete_rows(df: DataFrame, cols) -> DataFrame:
    """Only rows whose every predictor is a usable number."""
    return df.na.drop(subset=list(cols)).where(all_finite(cols))


def binarise(df: DataFrame, threshold, value: str = "value", missing: int = 0,
             out: str = "binary") -> DataFrame:
    """1 at or above the threshold, else 0; missing values become ``missing`` (0 or 255)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn(out, F.when(~finite(value), F.lit(missing))
                         .when(F.col(value) >= t, F.lit(1)).otherwise(F.lit(0)))


def spread_or_one(sd: Column) -> Column:
    return F.when(sd < MIN_SPREAD, F.lit(1.0)).otherwise(sd)
