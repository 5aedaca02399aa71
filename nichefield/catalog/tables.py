"""Habitat-shaped tables derived from the given business tables.

One SQL text serves both engines: ``{G}`` is the grid side, which grows with the data, and
``{each:...}`` multiplies rows by a short list.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, Layer
from ..operators.common import shuffle_width

SIZE = "select greatest(16, cast(floor(sqrt(count(*)) / 6) as int)) as g from lineitem"

SQL = {
    "fx_cells": """
select r as row, cl as col, cl + 0.5e0 as x, {G} - (r + 0.5e0) as y,
  avg(l_quantity) as p1, max(l_extendedprice) as p2,
  case when (r * 7 + cl * 3) % 23 = 0 then null else avg(pct) end as p3
from (select l_quantity, l_extendedprice, cast(round(l_discount * 100e0) as int) as pct,
        cast(l_orderkey % {G} as int) as r, cast((l_partkey + l_linenumber) % {G} as int) as cl
      from lineitem) t
group by r, cl""",
    "fx_future": "select row, col, x, y, p1 + 6e0 as p1, p2 - 4000e0 as p2, p3 from fx_cells",
    "fx_occ": """
select event_id as rid, cast(user_id % 5 as int) as species,
  case when event_id % 53 = 0 then null when event_id % 41 = 0 then 0e0
       else cast((user_id * 37 + event_id) % (4 * {G} + 10) as double) * 0.25e0 end as x,
  case when event_id % 41 = 0 then 0e0 else cast((event_id * 13) % (4 * {G} + 8) as double) * 0.25e0 end as y,
  case when event_type in ('purchase', 'signup') then 1 else 0 end as presence
from events""",
    "fx_matrix": """
select l_orderkey * 10 + l_linenumber as pid,
  max(case when l_extendedprice + case when l_returnflag = 'R' then 20000 else 0 end > 60000 then 1 else 0 end) as label,
  max(l_quantity) as a, max(l_extendedprice) as b, max(l_extendedprice * (1e0 - l_discount)) as c,
  max(l_discount) as d, max(l_tax) as e, 5e0 as konst
from lineitem group by l_orderkey * 10 + l_linenumber""",
    "fx_oof": """
select pid, label, algorithm, replicate,
  case when algorithm = 'enfa' and pid % 97 = 0 then null
       when algorithm = 'lr' then round(b / 100000e0 * 0.7e0 + d * (1 + replicate), 4)
       when algorithm = 'rf' then round(a / 50e0 * 0.8e0 + e * (1 + replicate), 4)
       else round(d * 5e0 + e * 5e0 * (1 + replicate), 4) end as score
from (select s.*, {each:'lr','rf','enfa'} as algorithm
      from (select m.*, {each:0,1} as replicate from fx_matrix m) s) t""",
    "fx_preds": """
select row, col, algorithm, replicate,
  case when (row + col * 2 + k) % 19 = 0 then null
       else round(cast((row * k + col * 3 + replicate * 5) % 101 as double) / 101e0, 4) end as value
from (select row, col, replicate, algorithm,
        case algorithm when 'lr' then 7 when 'rf' then 11 else 13 end as k
      from (select row, col, algorithm, {each:0,1,2} as replicate
            from (select row, col, {each:'lr','rf','enfa'} as algorithm from fx_cells) a) b) t""",
    "fx_metrics": """
select species, algorithm, replicate,
  case when q % 23 = 0 then null else (300 + q * 37 % 350) / 500e0 end as auc,
  case when q % 23 = 0 then null else (q * 53 % 600 - 100) / 500e0 end as tss,
  case when q % 23 = 0 or q % 7 = 0 then null else (q * 29 % 1000 - 500) / 500e0 end as boyce,
  case when q % 23 = 0 or q % 5 = 0 then null else (q * 17 % 500) / 500e0 end as threshold
from (select cast(l_suppkey as int) as species,
        case cast(l_linenumber as int) % 3 when 0 then 'lr' when 1 then 'rf' else 'enfa' end as algorithm,
        cast(l_partkey % 3 as int) as replicate, cast(sum(cast(l_quantity as int)) as bigint) as q
      from lineitem group by 1, 2, 3) t""",
    "fx_runs": """
select cast(l_suppkey as int) as species, count(*) % 130 as n_presence,
  case when count(*) % 2 = 0 then 'spatial_block' when count(*) % 3 = 0 then 'kfold' else 'random' end as split_method,
  (count(*) * 7 % 400) / 1000e0 as disagreement_share, (count(*) * 11 % 700) / 1000e0 as suitable_share,
  case when count(*) % 5 = 0 then null else (count(*) * 3 % 350) / 1000e0 end as extrapolated_share,
  (700 + count(*) * 13 % 300) / 1000e0 as train_auc, (600 + count(*) * 5 % 350) / 1000e0 as cv_auc,
  count(*) % 4 = 0 as has_maxent, cast(count(*) % 3 as int) as n_dropped, count(*) % 2 = 1 as presence_only,
  (count(*) * 17 % 450) / 1000e0 as removed
from lineitem group by l_suppkey""",
    "fx_layer_values": """
select 'p1' as layer, row, col, case when (row + col) % 29 = 0 then -9999e0 else p1 end as value from fx_cells
union all
select 'p2' as layer, row, col, case when (row + col) % 31 = 0 then -9999e0 else p2 end as value from fx_cells""",
    "fx_coarse": """
select 'soil' as layer, cast(row as int) as row, cast(col as int) as col,
  case when (row * 3 + col) % 17 = 0 then null else v end as value
from (select cast(floor(row / 2) as int) as row, cast(floor(col / 2) as int) as col,
        max(p2) / 7.77e0 as v from fx_cells group by 1, 2) t""",
    "fx_env": """
select vec_id as pid, case when label < 3 then 1 else 0 end as label, {env} from embeddings""",
    "fx_importance": """
select algorithm, replicate, feature, (q * 31 % 700 - 100) / 1000e0 as importance
from (select case cast(l_partkey as int) % 3 when 0 then 'lr' when 1 then 'rf' else 'enfa' end as algorithm,
        cast(l_suppkey as int) as replicate, concat('f', cast(l_linenumber as varchar(10))) as feature,
        cast(sum(cast(l_quantity as int)) as bigint) as q
      from lineitem group by 1, 2, 3) t
where (replicate + cast(substr(feature, 2) as int)) % 5 <> 0""",
    "fx_curves": """
select algorithm, replicate, feature, grid_i,
  cast(grid_i as double) * (case feature when 'f0' then 2 when 'f1' then 4 else 8 end)
    + case algorithm when 'lr' then 0e0 when 'rf' then 1e0 else 3e0 end as grid_v,
  (q * 17 % 1000) / 1000e0 as pred
from (select case cast(l_suppkey as int) % 3 when 0 then 'lr' when 1 then 'rf' else 'enfa' end as algorithm,
        cast(l_partkey % 4 as int) as replicate, concat('f', cast(cast(l_linenumber as int) % 3 as varchar(10))) as feature,
        cast(l_quantity as int) - 1 as grid_i, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as q
      from lineitem group by 1, 2, 3, 4) t""",
}
_TABLES = ("lineitem", "events", "embeddings")
TASK_ROWS = 500_000  # records that one task groups at most: more records make more tasks, not larger ones


def _needs(name: str) -> list[str]:
    return [t for t in SQL if t != name and re.search(rf"\b{t}\b", SQL[name])]


def with_tables(select: str) -> str:
    """A DuckDB query: the derived tables ``select`` mentions as common table expressions."""
    names: list[str] = []

    def visit(name):
        for n in _needs(name):
            visit(n)
        if name not in names:
            names.append(name)

    for t in SQL:
        if re.search(rf"\b{t}\b", select):
            visit(t)
    parts = [f"fx_size as materialized ({SIZE})"]
    for n in names:
        text = re.sub(r"\{each:([^}]*)\}", r"unnest([\1])", SQL[n])
        text = text.replace("{env}", ", ".join(f"cast(embedding[{i}] as double) as e{i}" for i in (1, 2, 3)))
        parts.append(f"{n} as materialized ({text})")
    ctes = ",\n".join(parts)
    body = select.strip()
    if body.lower().startswith("with "):
        text = f"with {ctes},\n{body[5:]}"
    else:
        text = f"with {ctes}\n{body}"
    return text.replace("{G}", "(select g from fx_size)")


class Data:
    """The derived tables as DataFrames, for one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def side(self) -> int:
        return self.spark.sql(SIZE.replace("lineitem", "{lineitem}"), lineitem=self.given("lineitem")).first().g

    @property
    def matrix_parts(self) -> int:
        """Parts of at most ``TASK_ROWS`` records; the grid side tells how many records there are."""
        return -(-36 * (self.side + 1) ** 2 // TASK_ROWS)

    @property
    def grid(self) -> Grid:
        return Grid(0.0, float(self.side), 1.0, 1.0, self.side, self.side, "EPSG:32633")

    def __getattr__(self, name: str) -> DataFrame:
        table = f"fx_{name}"
        if table not in SQL:
            raise AttributeError(name)
        text = re.sub(r"\{each:([^}]*)\}", r"explode(array(\1))", SQL[table])
        text = text.replace("{env}", ", ".join(f"cast(element_at(embedding, {i}) as double) as e{i}" for i in (1, 2, 3)))
        text = text.replace("{G}", str(self.side))
        used = {t: self.given(t) for t in _TABLES if re.search(rf"\b{t}\b", text)}
        if table == "fx_matrix" and self.matrix_parts > shuffle_width(self.spark):
            used["lineitem"] = used["lineitem"].repartition(self.matrix_parts, F.expr("l_orderkey * 10 + l_linenumber"))
        used |= {t: getattr(self, t[3:]) for t in _needs(table)}
        for t in used:
            text = re.sub(rf"(from|join) {t}\b", rf"\1 {{{t}}}", text)
        df = self.spark.sql(text, **used)
        self.__dict__[name] = df
        return df

    @property
    def layers(self) -> list[Layer]:
        return [Layer.on_grid("p1", self.grid, nodata=-9999.0), Layer.on_grid("p2", self.grid)]

    @property
    def coarse_layer(self) -> Layer:
        half = -(-self.side // 2)
        return Layer("soil", "EPSG:32633", "float32", half, half, 2.0, 0.0, 0.5, 0.0, -2.0, float(self.side))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and never -0.0) so both engines print the same value."""
    return df.select(*[(F.round(F.col(n).cast("double"), digits) + F.lit(0.0)).alias(n) if t in ("double", "float")
                       else F.col(n) for n, t in df.dtypes])


def r(expr: str, name: str = "", digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round({expr}, {digits}) + 0e0 as {name or expr}"


def uniform(text: str) -> str:
    """Hashed number in [0, 1) of a SQL text expression."""
    return f"(cast('0x' || substr(md5({text}), 1, 8) as ubigint) / 4294967296e0)"
