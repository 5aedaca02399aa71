"""Occurrence points from delimited text and GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_number

# Separator by file extension.
SEPARATORS = {".csv": ",", ".txt": ",", ".tsv": "\t"}


def _separator(path: str) -> str:
    for ext, sep in SEPARATORS.items():
        if path.lower().rstrip("/").endswith(ext):
            return sep
    raise ValueError(f"unsupported occurrence file extension: {path}")


def read_points(spark: SparkSession, path: str, x: str = "x", y: str = "y", presence: str | None = None,
                rid: str | None = None) -> DataFrame:
    """A1: points with ``rid`` (input order), ``x``, ``y`` and ``presence`` clipped to 0 or 1.

    ``path`` may be a file or a folder named ``*.csv``, ``*.txt`` or ``*.tsv``. Without a ``rid``
    column rows are numbered in scan order, which is file order for a single file; several files have no
    order of their own and need the column.
    """
    raw = spark.read.csv(path, header=True, sep=_separator(path), enforceSchema=False)
    if x not in raw.columns or y not in raw.columns:
        raise ValueError(f"missing coordinate columns {x!r} / {y!r}; available: {raw.columns}")
    for name in (presence, rid):
        if name and name not in raw.columns:
            raise ValueError(f"column {name!r} not found; available: {raw.columns}")
    if not rid and len(raw.inputFiles()) > 1:
        raise ValueError("several files have no input order; name a rid column")
    order = F.col(rid).cast("bigint") if rid else F.monotonically_increasing_id()
    flag = F.lit(1)
    if presence:
        flag = F.least(F.lit(1), F.greatest(F.lit(0), F.col(presence).cast("double").cast("int")))
    return raw.select(order.alias("rid"), clean_number(F.col(x).try_cast("double")).alias("x"),
                      clean_number(F.col(y).try_cast("double")).alias("y"), flag.alias("presence"))


def read_geojson_points(spark: SparkSession, path: str, presence: str | None = None,
                        multiline: bool = False) -> DataFrame:
    """A2: one row per Point, or first coordinate of a MultiPoint; other geometries are skipped.

    Each document is a FeatureCollection or a single Feature. One document per line lets Spark
    split large inputs; ``multiline`` reads a pretty-printed file as a whole. A missing presence
    property counts as 0 and values are not clipped.
    """
    feature = "struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
    schema = f"features array<{feature}>, geometry struct<type:string,coordinates:string>, properties map<string,string>"
    docs = spark.read.schema(schema).json(path, multiLine=multiline)
    alone = F.array(F.struct("geometry", "properties"))
    rows = docs.select(F.explode(F.coalesce("features", F.when(F.col("geometry").isNotNull(), alone))).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.when(kind == "Point", F.from_json(text, "array<double>")).when(
        kind == "MultiPoint", F.from_json(text, "array<array<double>>")[0])
    flag = F.lit(1)
    if presence:
        flag = F.coalesce(F.col("f.properties")[presence].cast("double").cast("int"), F.lit(0))
    found = rows.select(point.alias("p"), flag.alias("presence")).where("p is not null")
    if found.isEmpty():
        raise ValueError(f"no point features found in {path}")
    return found.select(F.monotonically_increasing_id().alias("rid"), F.col("p")[0].alias("x"),
                        F.col("p")[1].alias("y"), "presence")
