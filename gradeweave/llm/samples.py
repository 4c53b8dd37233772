"""Bounded, repeatable samples of labelled rows, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def bounded_sample(rows: DataFrame, by: str, per_class: int) -> DataFrame:
    """doc_id and ``by`` of at most ``per_class`` rows of each class, in order of a hash of
    the id, so that the same table gives the same sample. Null ids and classes are left out.
    """
    # A class may have most rows: the first of each bucket are found apart, and only they meet.
    in_bucket = Window.partitionBy(by, "bucket").orderBy("order", "doc_id")
    first = Window.partitionBy(by).orderBy("order", "doc_id")
    return (
        rows.select("doc_id", by)
        .where(F.col("doc_id").isNotNull() & F.col(by).isNotNull())
        .withColumn("order", F.md5(F.col("doc_id").cast("string").cast("binary")))
        .withColumn("bucket", F.substring("order", 31, 2))
        .withColumn("place", F.row_number().over(in_bucket))
        .where(F.col("place") <= per_class)
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= per_class)
        .select("doc_id", by)
    )


def texts_of(docs: DataFrame, sample: DataFrame, by: str) -> DataFrame:
    """text and class of the sampled documents. The sample is bounded, so it is broadcast."""
    chosen = sample.select(F.col("doc_id").alias("sampled_id"), F.col(by).alias("label"))
    joined = docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("sampled_id")
    )
    return joined.select("doc_id", "text", "label")
