"""A corpus pipeline over the documents table.

Documents of poor quality go; of each group of near copies one stays; personal data is taken
out; sources are mixed to their targets, in training order; the result is packed into
sequences. Each stage reads what the stage before has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeweave.llm import quality, queries
from gradeweave.llm.curriculum import planned, repeated
from gradeweave.llm.disclosure import cleaned
from gradeweave.llm.jaccard import one_of_each
from gradeweave.llm.packing import pack
from gradeweave.sources.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near copies: shingles of so many words, and the least similarity in percent.
WORDS = 5
SIMILAR = 80

# Pre-tokens that a worker keeps: fewer than in a job of its own, for the executors of a
# pipeline hold the memory of earlier stages too.
MEMO = 250_000

# Bytes of one Arrow batch. Spark's default of 64 MB stands several times in the memory of an
# executor: for each of its tasks in the JVM and, twice or more, in the Python worker.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches of this session from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF keeps; it learns from the labels of the table."""
    small_batches(spark)
    model = quality.fit(docs, queries.labels(spark, sf_dir))
    return quality.retained(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    small_batches(spark)
    return one_of_each(docs, k=WORDS, percent=SIMILAR)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without personal data and the terms that disclose it."""
    return cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return repeated(docs, planned(docs)).drop("position")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, in sequences."""
    small_batches(spark)
    return pack(docs, queries.tokenizer_path(), memo=MEMO)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("near-copies", distinct),
    ("personal-data", private),
    ("mix", mixed),
    ("pack", packed),
]

# The quality stage decodes a trained model and the last one tokenizes: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written and read again but the last."""
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
