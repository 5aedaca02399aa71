"""Removal of long byte strings that occur more than once, with a logarithmic family of suffix arrays.

A suffix array here holds suffixes to the depth that matters: it is sorted by the fingerprint of a suffix's first
``length`` bytes, so equal strings are neighbours. A shard keeps a family of such arrays. A new batch is sorted, scanned
for neighbours of its own, merge-scanned against each existing level (marking both sides of a match), and becomes a
level; levels of about equal size merge, so the sizes grow geometrically and each entry is merged a logarithmic number
of times. The batches of a shard are the packets that the tasks of a shuffle send it.

Not every suffix is sent. Each window of ``length`` bytes has an anchor, the leftmost least-hashed gram in it, which
depends on the window alone: equal windows have equal anchors. Neighbouring windows share their anchor, and the anchor's
region is all their bytes.

1. Anchors meet by gram. A gram that occurs once ends there. Equal regions repeat as a whole. Where regions differ, the
   windows of each odd region, and of one representative of each repeated one, have to be looked at one by one.
2. Those windows meet by fingerprint in the level families.
3. The windows found are united per document and their bytes removed.

Fingerprints have 64 bits (regions: two of them). Frequent grams and windows are combined in the sending task, so a
string in a third of all texts reaches its shard a few times per task.

Defined cases: a null or empty text has no bytes; a text shorter than ``length`` loses nothing; repeated rows are
repeats of each other; a null identifier is carried like any other. Removal may cut a character in two: the rest is
bytes, not text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pieces, shuffle_width, table, texts, utf8
from .shingles import mix

LENGTH, GRAM = 400, 200
#: Bytes hashed at once; a longer text is worked on in overlapping parts.
PART_BYTES = 1 << 20
#: Entries that a task combines before sending, and that one shard should get.
FLUSH_ENTRIES, SHARD_ENTRIES = 600_000, 200_000
#: Different regions of one gram in a flush beyond which they are all looked at window by window at once.
HOT_REGIONS = 64
#: Ranges that may be broadcast to the texts they belong to (about 40 bytes each).
BROADCAST_RANGES = 1_000_000
_BASE = 0x9E3779B97F4A7C55


@lru_cache(maxsize=1)
def _powers(n: int):
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Prints:
    """Fingerprints of any stretch of a byte string."""

    def __init__(self, data: np.ndarray):
        size = max(PART_BYTES + LENGTH, len(data))
        self.up, self.down = _powers(1 << (size - 1).bit_length() if size > PART_BYTES + LENGTH else size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        # Bytes are spread before they are summed, so that the low bits of a print depend on more than parities.
        np.cumsum(_SPREAD[data] * self.up[:len(data)], dtype=np.uint64, out=self.sums[1:])

    def fixed(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:len(x)] = x
    grid = padded.reshape(-1, width)
    after = np.minimum.accumulate(grid, axis=1).ravel()
    before = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:n], after[width - 1:width - 1 + n])


def parts(text: bytes, length: int, size: int = PART_BYTES):
    """(offset, bytes) so that each window starts in exactly one part."""
    for start in range(0, max(1, len(text) - length + 1), size):
        yield start, text[start:start + size + length - 1]


def anchored(texts: list[bytes], length: int, gram: int):
    """For texts, each shorter than a part: (text, first window, last window, gram print, region print) by anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    prints = Prints(data)
    grams = prints.fixed(gram)
    owner = sliding_least((grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & np.uint64(0xFFFFFFFF)
    which = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[:len(owner)]
    inside = np.arange(len(owner)) + length <= ends[which]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    own = owner[at]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    lo, hi = at[first], at[np.r_[first[1:] - 1, len(at) - 1]]
    anchor = own[first].astype(np.int64)
    region = mix(prints.at(lo, hi + length) + mix((anchor - lo).astype(np.uint64) + np.uint64(7)))
    begin = np.r_[0, ends[:-1]][which[lo]]
    # Anchors have small prints, as the least are chosen; mixed again, their high bits deal them evenly to the shards.
    return which[lo], lo - begin, hi - begin, mix(grams[anchor] * np.uint64(_BASE)), region


def runs(*sorted_keys: np.ndarray):
    """Starts and sizes of the runs of equal keys."""
    n = len(sorted_keys[0])
    change = np.zeros(max(0, n - 1), bool)
    for k in sorted_keys:
        change |= k[1:] != k[:-1]
    starts = np.flatnonzero(np.r_[True, change]) if n else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, n])


class LevelFamily:
    """Suffix arrays of geometrically growing sizes: (prints in order, whose suffix, where, repeated or not)."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, prints: np.ndarray, row: np.ndarray, at: np.ndarray, repeated: np.ndarray) -> None:
        order = np.argsort(prints, kind="stable")
        new = [prints[order], row[order], at[order], repeated[order]]
        starts, sizes = runs(new[0])
        new[3] = new[3] | np.repeat(sizes > 1, sizes)
        for level in self.levels:  # merge scan
            here = np.searchsorted(level[0], new[0])
            new[3] |= level[0][np.minimum(here, len(level[0]) - 1)] == new[0]
            there = np.searchsorted(new[0], level[0])
            level[3] |= new[0][np.minimum(there, len(new[0]) - 1)] == level[0]
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(-2), self.levels.pop()
            order = np.argsort(np.r_[a[0], b[0]], kind="stable")  # two runs: a merge
            self.levels.append([np.r_[x, y][order] for x, y in zip(a, b)])

    def found(self):
        for _, row, at, repeated in self.levels:
            yield row[repeated], at[repeated]


# --- packets: entries of one shard, packed column by column --------------------------------------------------------

_PACKET = "shard bigint, kind int, a binary, b binary, c binary, d binary, e binary"


def deal(shards: int, kind: int, key: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    shard = ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [c[order] for c in columns]
    cuts, sizes = runs(shard)
    return [(int(shard[i]), kind, *(c[i:i + n].tobytes() for c in columns), *[b""] * (5 - len(columns))) for i, n in zip(cuts.tolist(), sizes.tolist())]


def packets(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["shard", "kind", "a", "b", "c", "d", "e"])


def by_shard(batches):
    """(shard, its packets) of a partition sorted by shard."""
    current, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != current and held:
                yield current, held
                held = []
            current = row[0]
            held.append(row[1:])
    if held:
        yield current, held


def shuffled(df: DataFrame, shards: int) -> DataFrame:
    return df.repartition(max(shuffle_width(df.sparkSession), shards // 4), "shard").sortWithinPartitions("shard")


def joined(held, column: int, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(p[column], kind) for p in held])


# --- the steps ------------------------------------------------------------------------------------------------------

def _send_anchors(length: int, gram: int, shards: int):
    def flush(held):
        row, lo, hi, key, region = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((region, key))
        row, lo, hi, key, region = (x[order] for x in (row, lo, hi, key, region))
        starts, sizes = runs(key, region)
        copies = np.repeat(sizes > 1, sizes)
        lead = np.zeros(len(key), bool)
        lead[starts] = True
        out = []
        own = copies & ~lead  # regions repeated within this flush
        out += deal(shards, 1, mix(row[own]), row[own], lo[own], hi[own], np.zeros(own.sum(), np.uint8))
        row, lo, hi, key, region = (x[starts] for x in (row, lo, hi, key, region))
        many = (sizes > 1).astype(np.uint8)
        kstarts, ksizes = runs(key)
        hot = np.repeat(ksizes > HOT_REGIONS, ksizes)
        out += deal(shards, 2, mix(row[hot]), row[hot], lo[hot], hi[hot], many[hot])
        full = hot & (many == 1)
        out += deal(shards, 1, mix(row[full]), row[full], lo[full], hi[full], many[full])
        told = kstarts[ksizes > HOT_REGIONS]  # the shard hears that the gram occurs, in two regions
        out += deal(shards, 3, key[told], key[told])
        rest = ~hot
        out += deal(shards, 0, key[rest], key[rest], region[rest], row[rest], np.stack([lo[rest], hi[rest]], 1), many[rest])
        return packets(out)

    def work(batches):
        held, size = [], 0
        for piece in pieces(batches, limit=PART_BYTES):
            ids = piece.column("row").to_numpy(zero_copy_only=False).view(np.uint64)
            flat, rows, offsets = [], [], []
            for t, i in zip(utf8(piece.column("text")), ids):
                for offset, part in parts(t, length):
                    flat.append(part)
                    rows.append(i)
                    offsets.append(offset)
            step = 1 if len(flat) > 1 and len(ids) == 1 else max(1, len(flat))
            for k in range(0, len(flat), step):
                which, lo, hi, key, region = anchored(flat[k:k + step], length, gram)
                r, o = np.array(rows[k:k + step], np.uint64)[which], np.array(offsets[k:k + step], np.int64)[which]
                held.append((r, lo + o, hi + o, key, region))
                size += len(key)
            if size >= FLUSH_ENTRIES:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return work


def _meet_anchors(batches):
    """Rows (kind, row, lo, hi, many): 1 windows lo..hi are repeated, 2 windows to look at (many: repeated already)."""
    def out(kind, row, lo, hi, many):
        n = len(row)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(row.view(np.int64)), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64)),
                                           pa.array(many.astype(bool))], names=["kind", "row", "lo", "hi", "many"])

    for _, held in by_shard(batches):
        for kind in (1, 2):
            own = [p for p in held if p[0] == kind]
            if own:
                yield out(kind, joined(own, 1, np.uint64), joined(own, 2, np.int64), joined(own, 3, np.int64), joined(own, 4, np.uint8))
        own = [p for p in held if p[0] == 0]
        if not own:
            continue
        key, region, row = joined(own, 1, np.uint64), joined(own, 2, np.uint64), joined(own, 3, np.uint64)
        span, many = joined(own, 4, np.int64).reshape(-1, 2), joined(own, 5, np.uint8)
        order = np.lexsort((region, key))
        key, region, row, span, many = key[order], region[order], row[order], span[order], many[order]
        starts, sizes = runs(key, region)
        repeated = np.add.reduceat(many.astype(np.int64) + 1, starts) > 1
        kstarts, ksizes = runs(key[starts])
        told = [p for p in held if p[0] == 3]
        told = np.isin(key[starts][kstarts], joined(told, 1, np.uint64)) if told else np.zeros(len(kstarts), bool)
        mixed = np.repeat((ksizes > 1) | told, ksizes)  # by region: its gram has other regions too
        full = np.repeat(repeated, sizes)
        yield out(1, row[full], span[full, 0], span[full, 1], many[full])
        look = starts[mixed]
        yield out(2, row[look], span[look, 0], span[look, 1], repeated[mixed])


def _send_windows(length: int, shards: int):
    def flush(held):
        prints, row, at, many = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(prints, kind="stable")
        prints, row, at, many = prints[order], row[order], at[order], many[order]
        starts, sizes = runs(prints)
        again = np.repeat(sizes > 1, sizes)
        out = deal(shards, 1, mix(row[again]), row[again], at[again]) if again.any() else []
        many = np.maximum.reduceat(many, starts) | (sizes > 1).astype(np.uint8)
        return packets(out + deal(shards, 0, prints[starts], prints[starts], row[starts], at[starts], many))

    def work(batches):
        held, size = [], 0
        for piece in pieces(batches):
            for row, text, ranges in zip(piece.column("row").to_pylist(), utf8(piece.column("text")), piece.column("ranges").to_pylist()):
                # Windows to look at, bit 1; those of a representative are repeated already, bit 2.
                for offset, part in parts(text, length):
                    n = len(part) - length + 1
                    if n <= 0:
                        continue
                    wanted = np.zeros(n, np.uint8)
                    for r in ranges:
                        a, b = max(0, r["lo"] - offset), min(n, r["hi"] + 1 - offset)
                        if a < b:
                            wanted[a:b] |= 2 if r["many"] else 1
                    at = np.flatnonzero(wanted)
                    if len(at):
                        prints = Prints(np.frombuffer(part, np.uint8)).at(at, at + length)
                        held.append((prints, np.full(len(at), row, np.int64).view(np.uint64), (at + offset).astype(np.int64), (wanted[at] >> 1).astype(np.uint8)))
                        size += len(at)
                    if size >= FLUSH_ENTRIES:
                        yield flush(held)
                        held, size = [], 0
        if size:
            yield flush(held)

    return work


def _meet_windows(shards: int):
    def work(batches):
        for _, held in by_shard(batches):
            family, rows, places = LevelFamily(), [], []
            for p in held:
                if p[0] == 1:
                    rows.append(np.frombuffer(p[1], np.uint64))
                    places.append(np.frombuffer(p[2], np.int64))
                else:
                    family.add(np.frombuffer(p[1], np.uint64), np.frombuffer(p[2], np.uint64), np.frombuffer(p[3], np.int64), np.frombuffer(p[4], np.uint8).astype(bool))
            for row, at in family.found():
                rows.append(row)
                places.append(at)
            if sum(map(len, rows)):
                row, at = np.concatenate(rows), np.concatenate(places)
                yield packets(deal(shards, 0, mix(row), row, at, at))

    return work


def _unite(length: int):
    """Rows (row, spans): the maximal removed byte runs of each text."""
    def work(batches):
        for _, held in by_shard(batches):
            row, lo, hi = joined(held, 1, np.uint64), joined(held, 2, np.int64), joined(held, 3, np.int64)
            order = np.lexsort((lo, row))
            row, lo, stop = row[order], lo[order], hi[order] + length
            starts, sizes = runs(row)
            # The furthest stop so far within a text: texts are kept apart by an offset that grows with them.
            base = np.repeat(np.arange(len(starts)), sizes) * (int(stop.max()) + 1)
            far = np.maximum.accumulate(stop + base) - base
            new = np.r_[True, (row[1:] != row[:-1]) | (lo[1:] > far[:-1])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:] - 1, len(row) - 1]
            owner, a, b = row[first], lo[first], far[last]
            starts, sizes = runs(owner)
            ends = np.r_[starts, len(owner)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(owner[starts].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(a)),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(b))], names=["row", "starts", "stops"])

    return work


def _send_ranges(shards: int):
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                row = batch.column("row").to_numpy().view(np.uint64)
                yield packets(deal(shards, 0, mix(row), row, batch.column("lo").to_numpy(), batch.column("hi").to_numpy()))

    return work


def _of_texts(source: DataFrame, ranges: DataFrame, n: int, how: str) -> DataFrame:
    return source.join(F.broadcast(ranges) if n <= BROADCAST_RANGES else ranges.hint("merge"), "row", how)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_entries: int = SHARD_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(source, spans): texts with a row key, and by that key the byte runs [start, stop) that other places repeat."""
    source = texts(docs)
    source = source.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text"))
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(16, size // 100 // shard_entries)
    sent = source.select("row", "text").mapInArrow(_send_anchors(length, gram, shards), _PACKET)
    met = checkpointed(shuffled(sent, shards).mapInArrow(_meet_anchors, "kind int, row bigint, lo bigint, hi bigint, many boolean"))
    look = met.where("kind = 2")
    figures = look.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).alias("windows")).first()
    shards = max(16, figures["windows"] // shard_entries)
    ranges = look.groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "many")).alias("ranges"))
    windows = _of_texts(source.select("row", "text"), ranges, figures["n"], "inner").mapInArrow(_send_windows(length, shards), _PACKET)
    one_by_one = shuffled(windows, shards).mapInArrow(_meet_windows(shards), _PACKET)
    whole = met.where("kind = 1").select("row", "lo", "hi").mapInArrow(_send_ranges(shards), _PACKET)
    spans = shuffled(one_by_one.union(whole), shards).mapInArrow(_unite(length), "row bigint, starts array<bigint>, stops array<bigint>")
    return source, checkpointed(spans)


def remove(text: bytes, starts, stops) -> bytes:
    out, at = [], 0
    for a, b in zip(starts, stops):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def kept_bytes(docs: DataFrame, digests: bool = False, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without its repeated strings, as bytes or as a digest."""
    source, spans = repeated_spans(docs, **options)
    n = spans.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0)).alias("n")).first()["n"]
    rows = _of_texts(source, spans, n, "left")

    def work(batches):
        for piece in pieces(batches):
            many = utf8(piece.column("text"))
            starts, stops = (piece.column(k).to_pylist() for k in ("starts", "stops"))
            kept = [remove(t, a or (), b or ()) for t, a, b in zip(many, starts, stops)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([len(t) for t in many], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(many, kept)], pa.int64()),
                 pa.array([len(a or ()) for a in starts], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digests else pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = "string" if digests else "binary"
    return rows.select("doc_id", "text", "starts", "stops").mapInArrow(work, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kind}")


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    found = kept_bytes(table(spark, sf_dir, "documents"), digests=True).withColumnRenamed("kept", "kept_sha256")
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0)
    return found.withColumns({"has_repeat": F.col("n_removed") > 0, "removed_share": share})


QUERIES = {"op8_repeats": op8_repeats}
ORACLES: dict[str, str] = {}
