"""Seeded pseudo-random numbers that depend on values only, never on partitioning.

``rand()`` changes when a lost task is re-run on differently ordered input. Hashing the row's
own identity gives the same number on every run, on any cluster, and in any SQL engine with md5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0
HASH_BITS = 60  # of a sort key


def _column(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def hash_text(*parts) -> Column:
    """md5 of the parts joined by ``:``; plain Python values are literals."""
    return F.md5(F.concat_ws(":", *[_column(p) for p in parts]))


def hash_order(*parts) -> Column:
    """Seeded sort key: the leading 60 bits of the md5 as a number, in the text's order."""
    return F.conv(F.substring(hash_text(*parts), 1, 15), 16, 10).cast("bigint")


def hash_bytes(texts) -> Column:
    """The leading 8 bytes of each md5 text in one binary, for tasks that read sort keys as whole arrays (``sort_keys``)."""
    return F.unhex(F.concat(*[F.substring(t, 1, 16) for t in texts]))


def sort_keys(column: pa.Array, n: int) -> np.ndarray:
    """The numbers of ``hash_order`` for an array of ``hash_bytes``, one column for each of the ``n`` texts."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    words = np.frombuffer(column.buffers()[2], ">u8", len(column) * n, int(start)).reshape(-1, n)
    return (words >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def order_bucket(order: Column, buckets: int) -> Column:
    """Equal slices of the sort key's range, increasing with it."""
    return F.floor(order / F.lit(2.0**60 / buckets)).cast("int")


def unit_interval(digest: Column) -> Column:
    """Map an md5 text to [0, 1), keeping the text's sort order."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(_TWO_32)


def hash_uniform(*parts) -> Column:
    return unit_interval(hash_text(*parts))
