"""Projections, unions, samples and previews."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.sources.schemas import MISSING

PREVIEW_ROWS = 20


def keep_columns(df: DataFrame, positions: Collection[int]) -> DataFrame:
    """The columns at these positions, in the order of the table, not of the request."""
    return df.select(*[name for i, name in enumerate(df.columns) if i in positions])


def tagged(df: DataFrame, key: str, value: str, tag: str) -> DataFrame:
    """key, value and a constant tag, as k, v, tag."""
    return df.select(
        F.col(key).alias("k"), F.col(value).cast("long").alias("v"), F.lit(tag).alias("tag")
    )


def tagged_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both inputs, equal rows kept."""
    return first.unionByName(second)


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first n rows in the order of all columns (nulls first), or all if there are fewer."""
    return df.orderBy(*[F.col(name).asc_nulls_first() for name in df.columns]).limit(n)


def sample_by_digest(df: DataFrame, share: float = 0.25) -> DataFrame:
    """About this share of the rows, the same ones in every run and every engine.

    A row is drawn if the first 28 bits of the MD5 of its line, as a number, are below the
    share; equal rows are drawn together.
    """
    cells = [F.coalesce(F.col(name).cast("string"), F.lit(MISSING)) for name in df.columns]
    return df.where(_drawn(F.concat_ws(",", *cells), share))


def sample_rows(df: DataFrame, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """A random share of the rows, without replacement."""
    return df.sample(False, fraction, seed)


def sample_of_files(spark: SparkSession, path: str, share: float = 0.25) -> DataFrame:
    """About this share of the rows of a Parquet table, each drawn by its place in the files.

    A row is drawn by the first 28 bits of the MD5 of ``file:row``: the file's path behind
    ``path`` (empty if the table is one file) and the row's number in it, from 0. So equal rows
    are drawn apart, as in a random sample, but a task that is run again, another cluster or
    another way of splitting the files draws the same ones. Writing the table anew may change
    them.
    """
    named = F.concat(F.col("_metadata.file_path"), F.lit("/"))
    file = F.substring_index(named, f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    place = F.concat(F.rtrim(file, F.lit("/")), F.lit(":"), F.col("_metadata.row_index"))
    return spark.read.parquet(path).where(_drawn(place, share))


def _drawn(text: Column, share: float) -> Column:
    bound = f"{min(max(round(share * (1 << 28)), 0), 1 << 28):08x}"
    digest = F.md5(text.cast("binary"))
    return F.concat(F.lit("0"), F.substring(digest, 1, 7)) < bound
