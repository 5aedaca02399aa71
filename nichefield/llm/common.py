"""What the training-data operators share: tables, text batches, checked broadcasts, checkpoints.

Conventions of the whole subpackage: a null text counts as an empty one; operators read only the columns they
name, so extra columns are allowed and other columns may clash with nothing; identifiers are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import checkpointed, shuffle_width

__all__ = ["BROADCAST_KEYS", "ODD_NODES", "checkpointed", "keep_rows", "memory", "only", "with_keys", "with_nodes", "pieces", "prepare",
           "shuffle_width", "table", "texts", "utf8"]

#: A set of whole-number keys with at most this many rows (16 MB) may be broadcast; beyond it both sides shuffle.
BROADCAST_KEYS = 2_000_000
#: Bytes of text handed from the JVM to a Python worker at once, and worked on at once.
BATCH_BYTES = 8 << 20
PIECE_BYTES = 2 << 20


_memories: dict[str, Callable[[], None]] = {}


def memory(name: str, forget: Callable[[], None]) -> None:
    """Register what an operator remembers in a worker from batch to batch."""
    _memories[name] = forget


def only(name: str) -> None:
    """A worker serves one stage after another: what other operators remember there is given up."""
    for other, forget in _memories.items():
        if other != name:
            forget()


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes as well as rows: ten thousand very long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Identifier and whole text only, a null text as the empty one, so the scan reads two columns."""
    prepare(docs.sparkSession)
    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches, size_of: str = "text", limit: int = PIECE_BYTES):
    """Arrow batches cut into slices of about ``limit`` bytes of one column; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def with_keys(df: DataFrame, keys: DataFrame, on: str, how: str = "inner", rows: int | None = None,
              limit: int = BROADCAST_KEYS) -> DataFrame:
    """Join a large table to one that has a row per key.

    ``keys`` is counted (it should be checkpointed) and broadcast when it has at most ``limit`` rows; beyond
    that both sides shuffle on the key, where adaptive execution splits keys that are hot.
    """
    n = keys.count() if rows is None else rows
    return df.join(F.broadcast(keys) if n <= limit else keys.hint("merge"), on, how)


#: Nodes from here on stand for rows without an identifier of their own; real ones are smaller.
ODD_NODES = 1 << 62
NODE = "__row_node"


def with_nodes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with a row number in column ``NODE``, and whether any row has no identifier of its own.

    A row's number is its identifier. Where that is null, or belongs to several rows, it is a hash of identifier and text, so
    that only equal rows share one.
    """
    twice = checkpointed(docs.groupBy(F.col(ident).cast("bigint").alias("ident")).count().where("count > 1 or ident is null").select("ident", F.lit(True).alias("odd")))
    n, own = twice.count(), F.col(ident).cast("bigint")
    if not n:
        return docs.withColumn(NODE, own), False
    hashed = F.xxhash64(F.coalesce(own, F.lit(-1)), own.isNull(), F.coalesce(F.col(text), F.lit("")))
    numbered = docs.withColumns({NODE: own, f"{NODE}_odd": F.lit(ODD_NODES).bitwiseOR(hashed.bitwiseAND(F.lit(ODD_NODES - 1)))})
    other = twice.withColumnsRenamed({"ident": f"{NODE}_ident", "odd": f"{NODE}_flag"})
    marked = numbered.join(F.broadcast(other) if n <= BROADCAST_KEYS else other, F.col(NODE).eqNullSafe(F.col(f"{NODE}_ident")), "left")
    return marked.withColumn(NODE, F.when(F.col(f"{NODE}_flag"), F.col(f"{NODE}_odd")).otherwise(F.col(NODE))).select(*docs.columns, NODE), True


def keep_rows(docs: DataFrame, gone_of: Callable[[DataFrame], DataFrame], one_of_equal: bool) -> DataFrame:
    """``docs`` without the rows whose numbers (``doc_id``) ``gone_of`` returns for (doc_id = row number, text).

    Rows are judged and removed one by one, whatever their identifiers; of equal rows one stays if asked for.
    """
    keyed, odd = with_nodes(docs)
    if odd and one_of_equal:
        keyed = keyed.where(F.col(NODE) < ODD_NODES).union(keyed.where(F.col(NODE) >= ODD_NODES).dropDuplicates([NODE]))
    gone = checkpointed(gone_of(keyed.select(F.col(NODE).alias("doc_id"), "text")).select(F.col("doc_id").alias(f"{NODE}_gone")).distinct())
    left = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, F.col(NODE) == F.col(f"{NODE}_gone"), "left_anti")
    return left.select(*docs.columns)


def sha256_of(parts) -> str:
    return hashlib.sha256(b",".join(parts)).hexdigest()
