"""Exact deduplication through counting quotient filters.

A fingerprint of 64 bits is split into a quotient (its high bits) and a remainder (its low bits). Each partition
builds one counting filter: per shard of quotients the sorted remainders with their counts, packed in bytes. Filters
of the same shard merge without loss, as sorted lists do, by adding the counts of equal entries. Only texts whose
merged fingerprint counts more than one are then compared byte by byte; equal fingerprints decide nothing.

Defined cases: a null text counts as empty; an empty table gives an empty result; a repeated identifier is an ordinary
row of its group and is returned as often as it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, checkpointed, shuffle_width, table, texts, with_keys

#: Fingerprints that a merged shard should hold, about; the number of shards follows from the number of rows.
SHARD_ENTRIES = 1_000_000
#: Fingerprints that a task packs at once.
FILTER_ENTRIES = 1_000_000


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def pack(fingerprints: np.ndarray, counts: np.ndarray, bits: int):
    """One counting quotient filter: (quotient, remainders as sorted bytes, counts as bytes) for each quotient in use."""
    order = np.argsort(fingerprints, kind="stable")
    values, counts = fingerprints[order], counts[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    values, counts = values[starts], np.add.reduceat(counts, starts) if len(starts) else counts
    quotient, low = quotient_of(values, bits)
    cuts = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(values) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(values)]):
        yield int(quotient[a]), low[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes()


def quotient_of(values: np.ndarray, bits: int):
    """The high ``bits`` of each fingerprint, and the rest."""
    quotient = (values >> np.uint64(1)) >> np.uint64(63 - bits)
    return quotient, values - whole(quotient, bits)


def whole(quotient, bits: int):
    return np.uint64(quotient) << np.uint64(63 - bits) << np.uint64(1)


def merge(filters):
    """Add filters of one shard: sorted remainders stay sorted, counts of equal remainders are summed."""
    remainders = np.concatenate([np.frombuffer(r, np.uint64) for r, _ in filters])
    counts = np.concatenate([np.frombuffer(c, np.int64) for _, c in filters])
    order = np.argsort(remainders, kind="stable")
    remainders, counts = remainders[order], counts[order]
    starts = np.flatnonzero(np.r_[True, remainders[1:] != remainders[:-1]])
    return remainders[starts], np.add.reduceat(counts, starts)


def repeated_fingerprints(prints: DataFrame, bits: int) -> DataFrame:
    """Fingerprints (column ``fp``) that occur more than once, by merging the partitions' filters."""
    def build(batches):
        held, size = [], 0
        def flush():
            fp = np.concatenate(held).view(np.uint64)
            rows = list(pack(fp, np.ones(len(fp), np.int64), bits))
            return pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int64()),
                                               "remainders": pa.array([r[1] for r in rows], pa.binary()),
                                               "counts": pa.array([r[2] for r in rows], pa.binary())})
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            held, size = [*held, fp], size + len(fp)
            if size >= FILTER_ENTRIES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def combine(batches):
        def done(shard, filters):
            remainders, counts = merge(filters)
            again = remainders[counts > 1] + whole(shard, bits)
            return pa.RecordBatch.from_pydict({"fp": pa.array(again.view(np.int64), pa.int64()), "copies": pa.array(counts[counts > 1], pa.int64())})
        current, filters = None, []
        for batch in batches:  # sorted by shard: one shard is held at a time
            for shard, r, c in zip(*(batch.column(k).to_pylist() for k in ("shard", "remainders", "counts"))):
                if shard != current and filters:
                    yield done(current, filters)
                    filters = []
                current = shard
                filters.append((r, c))
        if filters:
            yield done(current, filters)

    filters = prints.select("fp").mapInArrow(build, "shard bigint, remainders binary, counts binary")
    parts = max(1 << bits, shuffle_width(prints.sparkSession))
    return filters.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(combine, "fp bigint, copies bigint")


def exact_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", bits: int | None = None,
                 broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): of equal texts the row with the largest identifier stays.

    Texts are read twice: once to fingerprint and digest them, once for the rows whose fingerprint repeats.
    A group of copies meets as one row per task that holds some of them.
    """
    both = texts(docs, ident, text)
    rows = checkpointed(both.select("doc_id", fingerprint(F.col("text")).alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha")))
    bits = max(4, (rows.count() // SHARD_ENTRIES).bit_length()) if bits is None else bits
    again = checkpointed(repeated_fingerprints(rows, bits).select("fp"))
    routed = with_keys(both.withColumn("fp", fingerprint(F.col("text"))), again, "fp", limit=broadcast_keys)
    # Byte verification: the text itself is the grouping key, so a shared fingerprint or digest joins nothing.
    groups = checkpointed(routed.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                          .where("group_size > 1").select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    joined = rows.join(F.broadcast(groups) if groups.count() <= broadcast_keys // 4 else groups, ["fp", "sha"], "left")
    return joined.select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                         F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each text: that of the largest identifier, null ones last; of several such rows one stays."""
    twice = checkpointed(exact_groups(docs, **options).where("group_size > 1").select(F.unhex("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep")).distinct())
    few, digest = twice.count() <= BROADCAST_KEYS // 4, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    keyed, other = docs.withColumn("__digest", digest), F.broadcast(twice) if few else twice
    alone = keyed.join(other, F.col("__digest") == F.col("__sha"), "left_anti")
    same = keyed.join(other, (F.col("__digest") == F.col("__sha")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__keep")))
    return alone.select(*docs.columns).union(same.dropDuplicates(["__digest"]).select(*docs.columns))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": """
    with d as (select doc_id, coalesce(text, '') as t from documents),
         g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
    select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
    from d join g on d.t = g.t"""}
