"""From raw documents to tokens: quality, exact copies, near copies, contamination, pieces.

Each stage reads what the one before kept, written as Parquet; its decision takes effect there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from nichefield.llm.common import table
from nichefield.llm.decontaminate import drop_contaminated
from nichefield.llm.exact_dedup import drop_copies
from nichefield.llm.ngram_join import drop_similar
from nichefield.llm.quality import keep_good
from nichefield.llm.sentencepieces import encode
from nichefield.operators.common import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, learned from the labels of those at hand."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets connect."""
    return drop_similar(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids in column ``pieces``."""
    return encode(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("contamination", contamination), ("pieces", pieces)]

#: The classifier cannot be said in SQL; the stages are tested against plain versions of each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
