"""Quality classifier by compression: two zstandard dictionaries, one from good and one from bad labelled text.

A text is cut into blocks over its whole length and each block is compressed with both dictionaries. The difference of
the two sizes over the text's size tells which of the two kinds of text it is like; with the size under the bad
dictionary (repetition compresses under any) a logistic curve turns it into a probability.

The dictionaries and the curve are fitted on a bounded sample of labelled rows, ``SAMPLE_ROWS`` of each label in the
order of a hash: two thirds of them give text for the dictionaries, at most ``BLOCKS_PER_TEXT`` blocks spread over
the length of each, the rest calibrate on their whole texts. The curve is weighted to the labels' true shares.

Defined cases: a null or empty text gets the score of no evidence, the curve at average figures; labels other than 0
and 1, and documents with both, teach nothing; with fewer than two labels to learn from all scores are the share of
label 1, or 0.5 without labels.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table, texts, utf8

SAMPLE_ROWS = 3000
BLOCK_BYTES, BLOCKS_PER_TEXT = 1024, 32
DICTIONARY_BYTES, LEVEL = 112 * 1024, 3


def held_out(ident):
    """Rows that the contract keeps from learning."""
    return F.pmod(F.crc32(ident.cast("string")), F.lit(3)) == 1


def blocks(text: bytes, size: int = BLOCK_BYTES) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)]


def train_dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


@lru_cache(maxsize=8)
def compressor(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def figures(text: bytes, good: bytes, bad: bytes) -> tuple[float, float]:
    """(size under good less size under bad, size under bad), both by the text's size; no figures for no text."""
    if not text:
        return float("nan"), float("nan")
    parts = blocks(text)
    g = sum(map(len, map(compressor(good).compress, parts)))
    b = sum(map(len, map(compressor(bad).compress, parts)))
    return (g - b) / len(text), b / len(text)


class Curve:
    """Weighted logistic regression on standardised figures."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean = np.average(x, axis=0, weights=weight)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=weight)) + 1e-9
        a = self._design(x)
        w = np.zeros(a.shape[1])
        for _ in range(100):
            p = self._share(a @ w)
            slope = a.T @ (weight * (p - y)) + 1e-1 * w
            step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + 1e-1 * np.eye(len(w)), slope)
            step *= min(1.0, 4 / (np.abs(step).max() + 1e-12))
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w

    @staticmethod
    def _share(z):
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def _design(self, x):
        return np.c_[(np.where(np.isnan(x), self.mean, x) - self.mean) / self.scale, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._share(self._design(x) @ self.w)


class QualityModel:
    def __init__(self, good: bytes = b"", bad: bytes = b"", curve: Curve | None = None, share: float = 0.5):
        self.good, self.bad, self.curve, self.share = good, bad, curve, share

    def __call__(self, many: list[bytes]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(many), self.share)
        return self.curve(np.array([figures(t, self.good, self.bad) for t in many]).reshape(-1, 2))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learn from the labelled rows that are not held out."""
    known = (labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
             .where(F.col("quality") == F.col("other")).where(~held_out(F.col("doc_id"))).select("doc_id", "quality"))
    known = known.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_semi")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return QualityModel(share=float(next(iter(counts), 0.5)))
    # At most sample_rows identifiers of each label, two thirds of them for the dictionaries.
    order = F.xxhash64("doc_id", F.lit("quality"))
    part = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample_rows) for q in (0, 1)]
    use = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3))
    sample = F.broadcast(part[0].union(part[1]).withColumn("calibrates", use == 0))
    rows = texts(docs).join(sample, "doc_id")

    def spread(batches):
        for piece in pieces(batches):
            found = []
            for text, q in zip(utf8(piece.column("text")), piece.column("quality").to_pylist()):
                own = blocks(text)
                found += [(q, own[i]) for i in np.unique(np.linspace(0, len(own) - 1, BLOCKS_PER_TEXT).astype(int))] if own else []
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["quality", "block"])

    taught = rows.where("not calibrates").select("quality", "text").mapInArrow(spread, "quality int, block binary").collect()
    both = [sorted(bytes(r["block"]) for r in taught if r["quality"] == q) for q in (0, 1)]
    if not both[0] or not both[1]:
        return QualityModel(share=counts[1] / (counts[0] + counts[1]))
    bad, good = map(train_dictionary, both)

    def measure(batches):
        for piece in pieces(batches):
            x = [figures(t, good, bad) for t in utf8(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("quality"), *(pa.array([v[k] for v in x], pa.float64()) for k in (0, 1))], names=["quality", "d", "r"])

    seen = rows.where("calibrates").select("quality", "text").mapInArrow(measure, "quality int, d double, r double").where("not isnan(d)").toPandas()
    seen = seen.sort_values(["quality", "d", "r"])
    if seen["quality"].nunique() < 2:
        return QualityModel(share=counts[1] / (counts[0] + counts[1]))
    y = seen["quality"].to_numpy(float)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()) * len(y) / sum(counts.values())
    return QualityModel(good, bad, Curve(seen[["d", "r"]].to_numpy(float), y, weight))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for piece in pieces(batches):
            s = shared.value(utf8(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = texts(docs).mapInArrow(work, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the documents that the classifier rejects, judged row by row in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))

    def work(batches):
        for piece in pieces(batches):
            good = model.value([t or b"" for t in utf8(piece.column("text"))]) >= 0.5
            yield piece.filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
