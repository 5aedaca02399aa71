"""Ranked lexical search over all documents, with buckets of impact vectors ordered by their length.

A score is the inner product of an item's term weights with a document's impacts. Documents become sparse vectors over
the terms that occur in the items; the square root of a term's weight goes to either side, which keeps both lengths small.
Vectors are range-partitioned by falling length (equal lengths by identifier, so that no group of copies stays together)
and read in buckets. For an item whose tenth score so far is T:

* a bucket whose longest vector times the item's length stays below T is passed over (Cauchy-Schwarz), and so are all
  shorter ones;
* inside, the item's heaviest coordinates are walked until the others, by the same inequality, cannot reach T alone; a
  document met there stays if the part found plus a bound for the rest reaches T: the lesser of Cauchy-Schwarz on what is left
  of both lengths, and the sum of the greatest values that the remaining coordinates take in this bucket;
* survivors are scored again in whole numbers, and only those scores count.

The partition with the longest vectors comes first and gives each item a first T; all others follow in one job, each
raising T by what it finds itself. Every task returns ten documents an item at most, which are merged in two steps.

Items are taken in blocks of ``ITEM_TERMS`` terms at most; only such a block travels to all tasks.

Defined cases: a null or empty text has no terms; an item without known terms gets no rows; equal scores come by ascending
identifier, null ones last; items or documents with equal or null identifiers are told apart and ranked row by row; texts of
any length count whole; empty tables give an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, pieces, shuffle_width, table, texts

#: Fixed values of the score: scale of weights and impacts, length share in per cent, saturation times the scale over 100.
SCALE, IMPACT, SHARE, SATURATION = 1000, 1_000_000_000, 75, 8
TOP = 10
#: Terms of the items that are searched for at once, repeats included.
ITEM_TERMS = 400_000
#: Vectors in a bucket.
BUCKET = 4096
#: What rounding of a few thousand sums may add to a bound.
SLACK = 1 + 1e-9
#: Bytes of a term as they are, capital letters as small ones, all others as blanks.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has terms: its length, the numbers of known terms, how often each occurs."""
    kind, known = ("<u2" if len(number) <= 1 << 16 else "<u4"), docs.sparkSession.sparkContext.broadcast(number)

    def work(batches):
        get, width = known.value.get, len(known.value) + 1
        for piece in pieces(batches):
            split = [terms_of(t) for t in piece.column("text").to_pylist()]
            n = np.array([len(s) for s in split], np.int64)
            ids = np.fromiter(map(get, chain.from_iterable(split), repeat(-1)), np.int64, int(n.sum()))
            keys = (np.repeat(np.arange(len(n)), n) * width + ids)[ids >= 0]
            keys, counts = np.unique(keys, return_counts=True)
            ends = np.searchsorted(keys, np.arange(1, len(n) + 1) * width)
            ids, terms, times, start = (keys % width).astype(kind), [], [], 0
            for end in ends.tolist():
                c = counts[start:end]
                terms.append(ids[start:end].tobytes())
                times.append(c.astype(f"<u{1 if not len(c) or c.max() < 256 else 4}").tobytes())
                start = end
            kept = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), pa.array(terms, pa.binary()), pa.array(times, pa.binary())],
                                             names=["doc_id", "n", "terms", "counts"]).filter(kept)

    return texts(docs).mapInArrow(work, "doc_id bigint, n bigint, terms binary, counts binary")


def _flat(batch, kind):
    """(entries of each row, all term numbers, all counts) of a batch of vectors."""
    terms, counts = batch.column("terms").to_pylist(), batch.column("counts").to_pylist()
    sizes = np.array([len(t) for t in terms], np.int64) // np.dtype(kind).itemsize
    ids = np.frombuffer(b"".join(terms), kind).astype(np.int64)
    times = [np.frombuffer(c, f"<u{len(c) // s}") for c, s in zip(counts, sizes.tolist()) if s]
    return sizes, ids, np.concatenate(times).astype(np.int64) if times else np.zeros(0, np.int64)


class Weights:
    """What the corpus says: number and length of its documents, and the weight of each known term."""

    def __init__(self, n_docs: int, n_terms: int, holders: np.ndarray):
        self.n_docs, self.n_terms, self.kind = n_docs, n_terms, "<u2" if len(holders) <= 1 << 16 else "<u4"
        self.weight = np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in holders.tolist()], np.int64)
        self.root = np.sqrt(self.weight)

    def damping(self, n: int) -> int:
        return 100 - SHARE + (SHARE * n * self.n_docs) // self.n_terms

    @staticmethod
    def impacts(times: np.ndarray, damping: np.ndarray) -> np.ndarray:
        return (IMPACT * times) // (SCALE * times + SATURATION * damping)


def weights_of(vecs: DataFrame, n_known: int) -> Weights:
    """Counts over all documents; what comes to the driver is a row and a number for each known term."""
    kind = "<u2" if n_known <= 1 << 16 else "<u4"

    def holders(batches):
        total = np.zeros(n_known, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), kind), minlength=n_known)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["term", "docs"])

    n_docs, n_terms = vecs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = np.zeros(n_known, np.int64)
    for r in vecs.select("terms").mapInArrow(holders, "term int, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        found[r["term"]] = r["docs"]
    return Weights(n_docs, n_terms, found)


def by_length(vecs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, damping, terms, counts, norm, part): vectors with known terms in partitions of falling length, checkpointed."""
    shared = vecs.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        w = shared.value
        for b in batches:
            sizes, ids, times = _flat(b, w.kind)
            damping = np.array([w.damping(n) for n in b.column("n").to_pylist()], np.int64)
            value = w.root[ids] * w.impacts(times, np.repeat(damping, sizes))
            norm = np.sqrt(np.add.reduceat(value * value, np.cumsum(sizes) - sizes)) if len(sizes) else value
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(damping), b.column("terms"), b.column("counts"), pa.array(norm)],
                                             names=["doc_id", "damping", "terms", "counts", "norm"])

    long = vecs.where(F.length("terms") > 0).mapInArrow(work, "doc_id bigint, damping bigint, terms binary, counts binary, norm double")
    order = [F.col("norm").desc(), F.col("doc_id")]
    return checkpointed(long.repartitionByRange(shuffle_width(vecs.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


class Bucket:
    """Some vectors of similar length, by row and by coordinate."""

    def __init__(self, batch, w: Weights):
        sizes, self.ids, times = _flat(batch, w.kind)
        self.ends = np.cumsum(sizes)
        self.sizes, self.norm = sizes, batch.column("norm").to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.impact = w.impacts(times, np.repeat(batch.column("damping").to_numpy(), sizes))
        order = np.argsort(self.ids, kind="stable")
        self.coordinate, self.row, self.value = self.ids[order], row[order], (w.root[self.ids] * self.impact)[order]
        self.null = np.array(batch.column("doc_id").is_null())
        self.doc = batch.column("doc_id").fill_null(0).to_numpy()

    def score(self, rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``factor`` holds the item's whole-number weight of each term."""
        sizes = self.sizes[rows]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.ends[rows] - sizes - first, sizes)
        return np.add.reduceat(factor[self.ids[at]] * self.impact[at], first) if len(rows) else np.zeros(0, np.int64)

    def survivors(self, terms: np.ndarray, heavy: np.ndarray, least: int) -> np.ndarray:
        """Rows that may reach ``least`` with an item of coordinates ``heavy``, heaviest first."""
        start, stop = np.searchsorted(self.coordinate, terms), np.searchsorted(self.coordinate, terms, side="right")
        here = np.flatnonzero(stop > start)
        start, stop, heavy = start[here].tolist(), stop[here].tolist(), heavy[here]
        rest = np.sqrt(np.concatenate([np.cumsum((heavy * heavy)[::-1])[::-1], [0.0]]))
        longest = self.norm[0] * SLACK
        if not len(here) or rest[0] * longest < least:
            return here[:0]
        focus = int(np.argmax(rest * longest < least)) if rest[-1] * longest < least else len(here)
        part, used = np.zeros(len(self.sizes)), np.zeros(len(self.sizes))
        for q, a, b in zip(heavy[:focus].tolist(), start, stop):
            rows, v = self.row[a:b], self.value[a:b]
            part[rows] += q * v
            used[rows] += v * v
        if len(part) >= TOP:
            least = max(least, math.floor(np.partition(part, -TOP)[-TOP] / SLACK))
        most = sum(q * self.value[a:b].max() for q, a, b in zip(heavy[focus:].tolist(), start[focus:], stop[focus:]))
        left = rest[focus] * np.sqrt(np.maximum(self.norm * self.norm * SLACK - used, 0))
        return np.flatnonzero((part > 0) & ((part + np.minimum(left, most)) * SLACK >= least))


class Item:
    """An item's terms, heaviest coordinate first, and its best documents so far."""

    def __init__(self, terms: dict[int, int], w: Weights, least: int):
        self.terms = np.array(sorted(terms), np.int64)
        times = np.array([terms[t] for t in self.terms.tolist()], np.int64)
        heavy = times * w.root[self.terms]
        order = np.argsort(-heavy, kind="stable")
        self.terms, self.heavy, self.weight, self.least = self.terms[order], heavy[order], (times * w.weight[self.terms])[order], max(least, 1)
        self.norm = math.sqrt(math.fsum((self.heavy * self.heavy).tolist()))
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def look(self, bucket: Bucket, factor: np.ndarray):
        rows = bucket.survivors(self.terms, self.heavy, self.least)
        if not len(rows):
            return
        factor[self.terms] = self.weight
        score = bucket.score(rows, factor)
        factor[self.terms] = 0
        kept = score >= self.least
        rows = rows[kept]
        score, null, doc = np.r_[self.score, score[kept]], np.r_[self.null, bucket.null[rows]], np.r_[self.doc, bucket.doc[rows]]
        best = np.lexsort((doc, null, -score))[:TOP]
        self.score, self.null, self.doc = score[best], null[best], doc[best]
        if len(best) == TOP:
            self.least = max(self.least, int(self.score[-1]))


HITS = "query int, doc_id bigint, score bigint, part int"


def hits(ordered: DataFrame, weights: Weights, items: list[dict[int, int]], least: list[int]) -> DataFrame:
    """The best documents of each partition for each item, of those that score ``least`` at least."""
    shared = ordered.sparkSession.sparkContext.broadcast((weights, items, least))

    def work(batches):
        w, asked, floors = shared.value
        factor, live = np.zeros(len(w.weight), np.int64), [(k, Item(t, w, x)) for k, (t, x) in enumerate(zip(asked, floors))]
        found, part = live, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                bucket = Bucket(batch.slice(at, BUCKET), w)
                part = batch.column("part")[at].as_py()
                longest = float(bucket.norm[0]) * SLACK
                live = [(k, item) for k, item in live if item.norm * longest >= item.least]  # buckets behind are shorter still
                for _, item in live:
                    item.look(bucket, factor)
            if not live:
                break
        rows = [(k, None if null else doc, score) for k, i in found for score, null, doc in zip(i.score.tolist(), i.null.tolist(), i.doc.tolist())]
        if rows:
            k, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64()), pa.array([part] * len(k), pa.int32())],
                                             names=["query", "doc_id", "score", "part"])

    return ordered.mapInArrow(work, HITS)


def _best(found: DataFrame, *by) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "part")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _blocks(items: DataFrame, ident: str, text: str):
    """Lists of (identifier, counted terms), each with ``ITEM_TERMS`` terms at most or a single item."""
    block, size = [], 0
    for ident_, text_ in items.select(F.col(ident).cast("bigint"), text).toLocalIterator():
        terms = Counter(terms_of(text_ or ""))
        if block and size + terms.total() > ITEM_TERMS:
            yield block
            block, size = [], 0
        block.append((ident_, terms))
        size += terms.total()
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents for each item, with scores above zero."""
    spark, out = docs.sparkSession, None
    for block in _blocks(items, ident, text):
        number = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in block))))}
        asked = [{number[t]: n for t, n in terms.items()} for _, terms in block]
        vecs = checkpointed(vectors(docs, number))
        weights = weights_of(vecs, len(number))
        ordered = by_length(vecs, weights)
        first = checkpointed(hits(ordered.where("part = 0"), weights, asked, [1] * len(asked)))
        least = [1] * len(asked)
        for r in first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == TOP).collect():
            least[r["query"]] = r["score"]
        rest = hits(ordered.where("part > 0"), weights, asked, least)
        salt = F.pmod(F.hash("part"), F.lit(max(1, math.isqrt(shuffle_width(spark)))))
        top = _best(_best(first.union(rest).withColumn("salt", salt), "query", "salt").drop("rank"), "query")
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "query int, item_id bigint")
        ranked = top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES = {"op11_lexical_search": f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
whole AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
words AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM words GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
items AS (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM items GROUP BY ALL),
scored AS (SELECT item, item_id, row, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term), whole GROUP BY item, item_id, row, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""}
