"""Keyed sums and counts, and grade lists of bounded length."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.operators.ranks import BLOCK_ROWS, running_sums
from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast
from gradeweave.sources.schemas import GRADES
from gradeweave.sources.shared import written

# Longest list in one row.
LIST_LENGTH = 1_000_000


def sum_count(df: DataFrame, *keys: str, value: str = "grade") -> DataFrame:
    """keys, s, n: sum and count of the non-null values per key.

    Both are partial aggregates: a task sends one row per key it has seen, so a key with a
    third of all rows costs the shuffle no more than any other.
    """
    return df.groupBy(*keys).agg(
        F.sum(F.col(value).cast("long")).alias("s"), F.count(value).alias("n")
    )


def count_rows(df: DataFrame) -> DataFrame:
    """n: the number of rows."""
    return df.agg(F.count("*").alias("n"))


def grade_lists(
    df: DataFrame,
    key: str,
    value: str = "grade",
    *,
    domain: Sequence[int] = GRADES,
    length: int = LIST_LENGTH,
) -> DataFrame:
    """key, part, grades: all grades of each key, ascending, as arrays.

    A key has one row per ``length`` grades (``part`` 0, 1, ...); laid end to end they are
    its whole list. Grades come from a fixed small domain, so what is shuffled is one
    counter per grade and key, and the arrays are written out from the counters. The parts
    of a key with more than one are spread over the tasks before that.

    ``domain`` lists the possible grades in ascending order; a null or another value fails
    the job.
    """
    outside = F.count_if(F.col(value).isNull() | ~F.col(value).isin(*domain))
    tallies = [F.count_if(F.col(value) == grade).alias(f"n{grade}") for grade in domain]
    counted = df.groupBy(key).agg(*tallies, outside.alias("outside"))
    complaint = F.concat(F.lit(f"value is no grade, {key} "), F.col(key).cast("string"))
    total = reduce(add, [F.col(f"n{grade}") for grade in domain])
    counted = counted.withColumn(
        "total",
        F.when(F.col("outside") > 0, F.raise_error(complaint).cast("long")).otherwise(total),
    )

    short = counted.where(F.col("total") <= length)
    whole = [F.array_repeat(F.lit(grade), F.col(f"n{grade}").cast("int")) for grade in domain]
    short_lists = short.select(
        key, F.lit(0).cast("long").alias("part"), F.concat(*whole).alias("grades")
    )

    last = F.expr(f"(total - 1) div {length}")
    long = (
        counted.where(F.col("total") > length)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .repartition(key, "part")
    )
    low = F.col("part") * length
    pieces = []
    start: Column = F.lit(0).cast("long")
    for grade in domain:
        end = start + F.col(f"n{grade}")
        shown = F.greatest(F.lit(0), F.least(end, low + length) - F.greatest(start, low))
        pieces.append(F.array_repeat(F.lit(grade), shown.cast("int")))
        start = end
    long_lists = long.select(key, "part", F.concat(*pieces).alias("grades"))

    return short_lists.unionByName(long_lists)


def value_lists(
    df: DataFrame,
    key: str,
    value: str,
    *,
    length: int = LIST_LENGTH,
    limit: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """key, part, values: all non-null values of each key, ascending, as arrays, for values of
    any domain that can be ordered.

    Part p holds the values of ranks p * ``length`` to (p + 1) * ``length`` - 1 of its key, at
    every length of the list, so parts laid end to end are the whole list. Keys of up to
    ``length`` values are collected in one shuffle. Of longer ones, of which there is at most one
    in ``length`` rows, equal values are counted and ranked block by block, so that no task holds
    or sorts a whole key; a value that fills several parts is written out by each of them.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, value)
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    long = written(
        total.where(F.col("total") > length).select(F.col(key).alias("_long")), "long-keys"
    )
    if long.isEmpty():
        return _short_lists(rows, key, value)
    hint = F.broadcast(long) if fits_broadcast(long, limit) else long
    is_long = F.col(key).eqNullSafe(F.col("_long"))
    short = _short_lists(rows.join(hint, is_long, "left_anti"), key, value)

    counted = (
        rows.join(hint, is_long, "left_semi")
        .groupBy(key, value)
        .agg(F.count("*").alias("times"))
    )
    ranked = running_sums(counted, value, "times", by=[key], name="low", block_rows=block_rows)
    low, high = F.col("low"), F.col("low") + F.col("times")
    first = F.col("part") * length
    shown = F.least(high, first + length) - F.greatest(low, first)
    runs = (
        ranked.withColumn(
            "part", F.explode(F.expr(f"sequence(low div {length}, (low + times - 1) div {length})"))
        )
        .select(key, "part", F.struct(value, shown.cast("int").alias("times")).alias("run"))
        .groupBy(key, "part")
        .agg(F.sort_array(F.collect_list("run")).alias("runs"))
    )
    repeated = F.transform("runs", lambda run: F.array_repeat(run[value], run["times"]))
    return short.unionByName(runs.select(key, "part", F.flatten(repeated).alias("values")))


def _short_lists(rows: DataFrame, key: str, value: str) -> DataFrame:
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))
    return lists.select(key, F.lit(0).cast("bigint").alias("part"), "values")


def explode_lists(lists: DataFrame, key: str, value: str = "grade") -> DataFrame:
    """key, value: one row per element of the lists.

    No list is empty, so the outer form gives the same rows; the inner one would build each
    list twice more to test that it is not empty.
    """
    return lists.select(key, F.explode_outer("grades").alias(value))


def list_text(grades: str = "grades") -> Column:
    """An array of grades as comma-separated text."""
    return F.concat_ws(",", F.col(grades).cast("array<string>"))
