"""N-gram Jaccard join with a prefix tree: groups of documents linked by the similarity of their shingle sets.

1. Equal sets are one class. Each class deals the first part of its set (in hash order) to the shuffle, packed by
   hash range and combined on the map side, so a shingle costs one entry per flush, however many documents hold it.
   Of two sets similar enough, the first common elements lie in both first parts; a class with too few shared ones
   cannot have a partner and goes. This is exact.
2. The classes left get their sets in one global order, rare shingles first (the most frequent ones, at most
   ``HOT_SHINGLES``, by the counts of step 1; the order decides speed only). Classes that share an element of their
   prefix, and have sizes that allow a link, meet in the block of the smallest of them: each pair that can be linked meets
   in some block. At first only the first parts of the sets go there, in which linked sets must share a known number of
   elements. Sets that this connects form groups, and each whole set travels once, to its group.
3. In a block the sets stand in a trie, and each set walks it with the overlap so far, leaving subtrees that the
   remaining lengths cannot lift to the threshold, or that are linked already. A large block is cut into chunks that
   each hold its first class; classes not linked to that one then meet the other chunks. Links are united by stars.

Sets are compared through 64-bit shingle hashes (57 bits within a pair). Defined cases: a null or empty text has an
empty set and is linked with nothing; rows are judged one by one, also those with null or repeated identifiers (real
identifiers are below 2**62), and a component is named by the smallest identifier in it, null if it has none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, NODE, ODD_NODES, checkpointed, keep_rows, pieces, shuffle_width, table, texts, utf8, with_keys, with_nodes
from .components import components
from .shingles import mix, shingle_sets

WIDTH = 5
#: The similarity as a whole percentage: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bound of the table of frequent shingles (16 bytes each) that orders the sets.
HOT_SHINGLES = 200_000
HOT_FROM = 16
#: Prefix entries in one bucket of the first shuffle, entries combined at once, shingles in one block of the join.
BUCKET_ENTRIES, FLUSH_ENTRIES, BLOCK_SHINGLES = 500_000, 700_000, 500_000


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Elements that a set of ``n`` shares with any partner at least."""
    return -(-n * percent // 100)


def slack(n: int) -> int:
    """Common elements asked for in the first parts of two sets; a longer first part allows more."""
    return max(1, n // 16)


def first_part(n: int, percent: int = PERCENT) -> int:
    return n - least_overlap(n, percent) + slack(n)


# --- step 1: which classes can have a partner -------------------------------------------------------------------

_BLOB = "bucket bigint, kind int, a binary, b binary, c binary, d binary"


def _deal(buckets: int, width: int, percent: int):
    def flush(held):
        h, who = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        runs = np.diff(np.r_[starts, len(h)])
        ids, n = np.unique(who[np.repeat(runs > 1, runs)], return_counts=True)
        rows = []
        if len(ids):  # shared within this flush: counted here
            rows.append((int(ids[0]) % buckets, 1, ids.tobytes(), n.astype(np.int64).tobytes(), b"", b""))
        # First parts hold the smaller hashes: they are mixed before they are dealt, so that buckets are even.
        bucket = ((mix(h[starts]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        bucket, runs = bucket[order], runs[order]
        h, who = h[starts][order], np.where(runs > 1, np.uint64(0), who[starts][order])
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
            rows.append((int(bucket[i]), 0, h[i:j].tobytes(), who[i:j].tobytes(), runs[i:j].astype(np.uint32).tobytes(), b""))
        return rows

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                           *(pa.array([r[k] for r in rows], pa.binary()) for k in range(2, 6))], names=["bucket", "kind", "a", "b", "c", "d"])

    def work(batches):
        held, size, seen = [], 0, set()
        for piece in pieces(batches):
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            sets = shingle_sets(utf8(piece.column("text")), width)
            keys = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2)
            keys[keys == 0] = 1
            sizes = np.array([len(s) for s in sets], np.int64)
            yield batch_of([(int(ids[0]) % buckets, 2, ids.tobytes(), sizes.tobytes(), keys[:, 0].tobytes(), keys[:, 1].tobytes())])
            for s, key in zip(sets, keys[:, 0].tolist()):
                if len(s) and key not in seen:
                    seen.add(key)
                    part = s[:first_part(len(s), percent)]
                    held.append((part, np.full(len(part), key, np.uint64)))
                    size += len(part)
            if size >= FLUSH_ENTRIES:
                yield batch_of(flush(held))
                held, size, seen = [], 0, set()
        if held:
            yield batch_of(flush(held))

    return work


def _gather(batches):
    """Rows (kind, key, n, doc_id, k2): 0 shared elements of class ``key``, 1 frequent shingle, 2 document."""
    def out(kind, key, n, doc=None, k2=None):
        m = len(key)
        null = pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)),
             null if doc is None else pa.array(doc), null if k2 is None else pa.array(k2.view(np.int64))], names=["kind", "key", "n", "doc_id", "k2"])

    def done(parts):
        h = np.concatenate([np.frombuffer(a, np.uint64) for a, _, _ in parts])
        who = np.concatenate([np.frombuffer(b, np.uint64) for _, b, _ in parts])
        held = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in parts])
        order = np.argsort(h, kind="stable")
        h, who, held = h[order], who[order], held[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        runs = np.diff(np.r_[starts, len(h)])
        ids, n = np.unique(who[np.repeat(runs > 1, runs) & (who != 0)], return_counts=True)
        yield out(0, ids, n)
        total = np.add.reduceat(held.astype(np.int64), starts)
        hot = total >= HOT_FROM
        if hot.any():
            yield out(1, h[starts][hot], total[hot])

    current, parts = None, []
    for batch in batches:  # sorted by bucket: one is held at a time
        for bucket, kind, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns)):
            if kind == 1:
                yield out(0, np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64))
            elif kind == 2:
                yield out(2, np.frombuffer(c, np.uint64), np.frombuffer(b, np.int64), np.frombuffer(a, np.int64), np.frombuffer(d, np.uint64))
            else:
                if bucket != current and parts:
                    yield from done(parts)
                    parts = []
                current = bucket
                parts.append((a, b, c))
    if parts:
        yield from done(parts)


def _first_pass(source: DataFrame, width: int, percent: int, buckets: int | None) -> DataFrame:
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = buckets or max(16, size // 20 // BUCKET_ENTRIES)  # a word takes some six bytes, a third of the shingles are dealt
    dealt = source.mapInArrow(_deal(buckets, width, percent), _BLOB)
    parts = max(shuffle_width(source.sparkSession), buckets // 8)
    return checkpointed(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
                        .mapInArrow(_gather, "kind int, key bigint, n bigint, doc_id bigint, k2 bigint"))


def _frequent(first: DataFrame, limit: int):
    """The most frequent shingles and their order classes: all above the lowest power of two that keeps to the limit."""
    hot = first.where("kind = 1").select("key", F.floor(F.log2("n")).cast("int").alias("level"))
    total, least = 0, 63
    for level, n in sorted(((r["level"], r["count"]) for r in hot.groupBy("level").count().collect()), reverse=True):  # 64 rows at most
        if total + n > limit:
            break
        total, least = total + n, level
    rows = hot.where(F.col("level") >= least).toPandas()
    key = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.minimum(rows["level"].to_numpy(np.int64)[order] + 1, 63).astype(np.uint64)


def ordered_sets(chosen: DataFrame, frequent, width: int) -> DataFrame:
    """(doc_id, n, keys): each set as ascending keys, the order class of a shingle in the high bits."""
    shared = chosen.sparkSession.sparkContext.broadcast(frequent)

    def work(batches):
        hot, level = shared.value
        for piece in pieces(batches):
            keys = []
            for s in shingle_sets(utf8(piece.column("text")), width):
                k = s >> np.uint64(7)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    k |= np.where(hot[at] == s, level[at], np.uint64(0)) << np.uint64(57)
                keys.append(np.sort(k).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], names=["doc_id", "n", "keys"])

    return chosen.mapInArrow(work, "doc_id bigint, n bigint, keys array<bigint>")


# --- step 3: the trie join of a block -----------------------------------------------------------------------------

class Trie:
    """Sorted sequences as a compressed trie: nodes are (first depth, last depth, leaf range, smallest and largest set, longest row, children)."""

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray):
        self.rows = rows
        common = [0]
        for a, b in zip(rows, rows[1:]):
            m = min(len(a), len(b))
            same = a[:m] == b[:m]
            common.append(m if same.all() else int(np.argmin(same)))
        common = np.array(common)
        self.nodes: list[tuple] = []
        todo = [(0, len(rows), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            end = len(rows[lo]) if hi - lo == 1 else int(common[lo + 1:hi].min())
            longest = max(map(len, rows[lo:hi]))
            self.nodes.append((depth, end, lo, hi, int(sizes[lo:hi].min()), int(sizes[lo:hi].max()), longest, []))
            me = len(self.nodes) - 1
            if parent >= 0:
                self.nodes[parent][7].append(me)
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1:hi] == end)).tolist(), hi]
                todo += [(a, b, end, me) for a, b in zip(cuts, cuts[1:])]


def common_asked(a: int, b: int, percent: int) -> int:
    """Elements that the first parts of two linked sets of ``a`` and ``b`` elements have in common at least.

    Of the elements in common, each set has all but those behind its first part in it, and the first few lie in both.
    """
    both = -(-percent * (a + b) // (100 + percent))
    return both - max(least_overlap(a, percent) - slack(a), least_overlap(b, percent) - slack(b))


def link_sets(names: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, sizes: np.ndarray | None = None) -> np.ndarray:
    """The smallest name of each set's component; sets of one group count as linked already.

    With ``sizes`` the sets are first parts of sets of those sizes, and what connects two is that their wholes may be linked.
    """
    k, parts = len(sets), sizes is not None
    lengths = np.array([len(s) for s in sets], np.int64)
    sizes = sizes if parts else lengths
    values, dense, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # The most frequent first, which shares more of the trie; what no other set holds only counts for the sizes.
    dense = (len(values) - 1 - dense).astype(np.int64)
    shared = (held > 1)[::-1]
    rows = [r[shared[r]][::-1] for r in np.split(dense, np.cumsum(lengths)[:-1])]
    order = sorted(range(k), key=lambda i: rows[i].astype(">u4").tobytes())
    rows, sizes, names, groups = [rows[i] for i in order], sizes[order], names[order], groups[order]
    trie = Trie(rows, sizes)
    root = np.unique(groups, return_inverse=True)[1].astype(np.int64)
    mark = np.zeros(len(values), bool)

    def short(overlap, nx, least, most):
        """Whether so many common elements are too few for any set of ``least`` to ``most``."""
        if parts:  # the number asked for rises and then falls with the size: the ends of the range decide, but for rounding
            return overlap < max(1, min(common_asked(nx, max(least, nx * percent // 100), percent), common_asked(nx, min(most, nx * 100 // percent + 1), percent)) - 2 * (least < most))
        return (100 + percent) * overlap < percent * (nx + least)

    for x in range(k - 1):
        xs, nx = rows[x], int(sizes[x])
        mark[xs] = True
        todo = [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            depth, end, lo, hi, least, most, longest, children = trie.nodes[node]
            if hi <= x + 1 or 100 * nx < percent * least or 100 * most < percent * nx or (root[max(lo, x + 1):hi] == root[x]).all():
                continue
            left = len(xs)
            if end > depth:
                segment = rows[lo][depth:end]
                overlap += int(np.count_nonzero(mark[segment]))
                left -= int(np.searchsorted(xs, segment[-1], side="right"))
            elif depth:
                left -= int(np.searchsorted(xs, rows[lo][depth - 1], side="right"))
            if short(overlap + min(left, longest - end), nx, least, most):
                continue
            if hi - lo > 1:
                todo += [(c, overlap) for c in children]
            elif not short(overlap, nx, least, least):
                root[root == root[lo]] = root[x]
        mark[xs] = False
    out = np.empty(k, np.int64)
    lowest = np.full(int(root.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, root, names)
    out[order] = lowest[root]
    return out


def _join_blocks(percent: int, parts: bool):
    def done(key, rows):
        names, groups, sizes = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        roots = link_sets(names, groups, [r[3] for r in rows], percent, sizes if parts else None)
        n = len(rows)
        return pa.RecordBatch.from_arrays([*(pa.array(np.full(n, v, np.int64)) for v in key), pa.array(names), pa.array(roots)],
                                          names=["block", "i", "j", "doc_id", "root"])

    def work(batches):
        current, rows = None, []
        for batch in batches:  # sorted by block and chunks
            keys = batch.column("keys")
            flat = keys.values.to_numpy()
            offsets = keys.offsets.to_numpy()
            for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j")))):
                if key != current and rows:
                    yield done(current, rows)
                    rows = []
                current = key
                rows.append((*(batch.column(c)[r].as_py() for c in ("doc_id", "grp", "n")), flat[offsets[r]:offsets[r + 1]].copy()))
        if rows:
            yield done(current, rows)

    return work


def _linked(members: DataFrame, sets: DataFrame, percent: int, parts: bool) -> DataFrame:
    """(block, i, j, doc_id, root) of each member row (block, i, j, doc_id, grp)."""
    size = members.join(sets.select("doc_id", F.size("keys").alias("m")), "doc_id").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()["m"]
    n = max(shuffle_width(members.sparkSession), size // (2 * BLOCK_SHINGLES))  # about 16 MB of sets in a task
    filled = members.join(sets.select("doc_id", "n", "keys"), "doc_id")
    return checkpointed(filled.repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j")
                        .mapInArrow(_join_blocks(percent, parts), "block bigint, i bigint, j bigint, doc_id bigint, root bigint"))


def prefix_members(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(block, doc_id): the sets that share an element of their prefix with ``block``, or share one that both have with it.

    Linked sets share an element of both prefixes, so each pair of them has a block in common. Only sets whose sizes allow a link
    count: a set stands in its own class of sizes and in the next, and classes grow by less than the largest ratio of linked sets.
    """
    need = F.floor((F.col("n") * percent + 99) / 100)
    klass = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    tokens = sets.select("doc_id", klass.alias("klass"), F.explode(F.slice("keys", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("key"))
    tokens = tokens.select("doc_id", "key", F.explode(F.array(F.col("klass"), F.col("klass") + 1)).alias("klass"))
    groups = tokens.groupBy("key", "klass").agg(F.min("doc_id").alias("block"), F.max("doc_id").alias("other")).where("block <> other").drop("other")
    return checkpointed(tokens.join(groups, ["key", "klass"]).select("block", "doc_id").distinct())


def block_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES, parts: bool = False) -> DataFrame:
    """Edges (u, v) that connect the sets of each block as all links between them do; ``sets`` has what a block compares."""
    sized = members.join(sets.select("doc_id", F.size("keys").cast("bigint").alias("m")), "doc_id")
    large = (sized.groupBy("block").agg(F.sum("m").alias("size")).where(F.col("size") > block_shingles)
             .select("block", F.ceil(F.col("size") / block_shingles).cast("bigint").alias("chunks")))
    large = checkpointed(large)
    if not large.count():
        rows = members.select("block", F.lit(0).cast("bigint").alias("i"), F.lit(-1).cast("bigint").alias("j"), "doc_id", F.col("doc_id").alias("grp"))
        return _linked(rows, sets, percent, parts).select(F.col("doc_id").alias("u"), F.col("root").alias("v")).where("u <> v")
    placed = members.join(large, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("bigint")))
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    own = placed.where("doc_id <> block").select("block", chunk.alias("i"), "doc_id")
    heads = placed.where("doc_id = block").select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("i"), "doc_id")
    rows = own.union(heads).select("block", "i", F.lit(-1).cast("bigint").alias("j"), "doc_id", F.col("doc_id").alias("grp"))
    first = _linked(rows, sets, percent, parts)
    # In a large block, what its first class does not reach meets the members of the other chunks.
    apart = first.join(large, "block").where("doc_id <> block")
    rest = checkpointed(apart.where("root <> block"))
    edges = first.select(F.col("doc_id").alias("u"), F.col("root").alias("v"))
    if rest.count():
        spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
        probes = rest.withColumn("j", spread).where("i <> j").select("block", "i", "j", "doc_id", F.col("root").alias("grp"))
        others = apart.withColumnRenamed("i", "own").withColumn("i", spread).where("i <> own")
        others = others.join(rest.select("block", "i").distinct(), ["block", "i"], "left_semi").select(
            "block", "i", F.col("own").alias("j"), "doc_id", F.col("root").alias("grp"))
        second = _linked(probes.union(others), sets, percent, parts)
        edges = edges.union(second.select(F.col("doc_id").alias("u"), F.col("root").alias("v")))
    return edges.where("u <> v")


def set_links(sets: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (u, v) that connect the sets as all links between them do.

    First only the first parts meet, in the blocks of shared prefix elements. Sets whose first parts leave a link possible are
    connected, and each whole set then travels once, to the block of its connected group.
    """
    n = F.col("n")
    need = F.floor((n * percent + 99) / 100)
    length = (n - need + F.greatest(F.lit(1), F.floor(n / 16))).cast("int")
    near = components(block_links(prefix_members(sets, percent), sets.select("doc_id", "n", F.slice("keys", F.lit(1), length).alias("keys")), percent, block_shingles, True))
    members = near.select(F.col("v").alias("block"), F.col("u").alias("doc_id")).union(near.select("v", "v").distinct())
    return block_links(checkpointed(members), sets, percent, block_shingles)


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int | None = None,
                   block_shingles: int = BLOCK_SHINGLES, broadcast_keys: int = BROADCAST_KEYS, hot_shingles: int = HOT_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest identifier reachable by links, the row's own included."""
    keyed, odd = with_nodes(texts(docs))
    source = keyed.select(F.col(NODE).alias("doc_id"), "text")
    first = _first_pass(source, width, percent, buckets)
    rows = first.where("kind = 2").select("doc_id", F.col("n").alias("n_shingles"), F.col("key").alias("k1"), "k2")
    classes = checkpointed(rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")))
    shared = first.where("kind = 0").groupBy(F.col("key").alias("k1")).agg(F.sum("n").alias("shared"))
    need = F.floor((F.col("n") * percent + 99) / 100)
    alive = checkpointed(classes.join(shared, "k1").where(F.col("shared") >= F.greatest(F.lit(1), F.floor(need / 16)))
                         .select(F.col("rep").alias("doc_id")).distinct())
    chosen = with_keys(source, alive, "doc_id", limit=broadcast_keys)
    sets = checkpointed(ordered_sets(chosen, _frequent(first, hot_shingles), width))
    edges = set_links(sets, percent, block_shingles)
    stars = components(edges)
    label = classes.join(stars, classes["rep"] == stars["u"], "left").select("k1", "k2", F.coalesce("v", "rep").alias("component_id"))
    found = rows.join(label, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return _own_identifiers(found, keyed) if odd else found


def _own_identifiers(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """Node numbers as the identifiers of their rows; a component's is the smallest that any of its rows has."""
    odd = checkpointed(keyed.where(F.col(NODE) >= ODD_NODES).select(F.col(NODE).alias("node"), F.col("doc_id").alias("ident")).distinct())
    known = found.join(odd, found["doc_id"] == odd["node"], "left").withColumn("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("ident")))
    known = checkpointed(known.select("doc_id", "n_shingles", "component_id", F.col("node").isNotNull().alias("odd")))
    least = known.where("odd").groupBy("component_id").agg(F.min("doc_id").alias("least"))
    named = F.when(F.col("component_id") < ODD_NODES, F.col("component_id"))
    return known.join(least, "component_id", "left").select("doc_id", "n_shingles", F.least(named, "least").alias("component_id"))


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest identifier, null and repeated ones last."""
    return keep_rows(docs, lambda keyed: similar_groups(keyed, **options).where("doc_id <> component_id").select("doc_id"), True)


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES = {"op1_ngram_join": r"""
    with recursive d as materialized (
        select doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                        '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda w: w <> '') as w from documents),
    s as materialized (
        select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
    n as materialized (select doc_id, count(*) as n from s group by doc_id),
    ids as materialized (select doc_id, g, count(*) over (partition by g) as df from s),
    o as materialized (select a.doc_id as a, b.doc_id as b, count(*) as o from ids a join ids b on a.g = b.g and a.doc_id < b.doc_id
                       where a.df > 1 and b.df > 1 group by a.doc_id, b.doc_id),
    link as materialized (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
    edge as materialized (select a, b from link union select b, a from link),
    reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
    least as (select a, least(a, min(b)) as c from reach group by a)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(l.c, d.doc_id) as component_id
    from d left join n on n.doc_id = d.doc_id left join least l on l.a = d.doc_id"""}
