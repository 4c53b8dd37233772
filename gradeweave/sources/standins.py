"""Offers, registrations and quantile points derived from a star schema in Parquet.

One order stands for one course offer, its lines for the registrations, and the part sizes
for the quantile points. Only renames and projections happen here, so column pruning
and the filters on plain columns reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The stored columns that are read. Given explicitly, so that no job looks them up first.
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"
LINEITEM = "l_orderkey bigint, l_suppkey bigint, l_quantity double"
PART = "p_size int"


def offers(spark: SparkSession, folder: str) -> DataFrame:
    """offer_id, course_id, yr, quartile."""
    return (
        spark.read.schema(ORDERS)
        .parquet(f"{folder}/orders.parquet")
        .select(
            F.col("o_orderkey").alias("offer_id"),
            F.col("o_custkey").alias("course_id"),
            F.year("o_orderdate").alias("yr"),
            F.quarter("o_orderdate").alias("quartile"),
        )
    )


def registrations(spark: SparkSession, folder: str) -> DataFrame:
    """offer_id, student_id, grade (1 to 10 or null)."""
    return spark.read.schema(LINEITEM).parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_orderkey").alias("offer_id"),
        F.col("l_suppkey").alias("student_id"),
        F.nullif(F.col("l_quantity").cast("int") % 11, F.lit(0)).alias("grade"),
    )


def point_rows(spark: SparkSession, folder: str) -> DataFrame:
    """q, one row per part: a bag with many equal points, most of them above every grade."""
    parts = spark.read.schema(PART).parquet(f"{folder}/part.parquet")
    return parts.select(F.col("p_size").alias("q"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """q, each once."""
    return point_rows(spark, folder).distinct()
