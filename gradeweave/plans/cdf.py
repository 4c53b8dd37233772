"""Cumulative grade counts: for each quantile point q, the grades at or below q.

All non-null grades count. A point below every grade has no row; equal points multiply the
count. The forms give the same rows. The first three start from the count per distinct grade,
so that no pair of a registration with a point is ever built. The counts are written, so
that planning the join by their size does not read the registrations twice. The last form
counts by rank, for grades and points of any number of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.grades import graded
from gradeweave.operators.pruned import compared, pruned_grid_join
from gradeweave.operators.ranks import counts_by_rank
from gradeweave.operators.theta import GRID, grid_join, theta_join
from gradeweave.sources.shared import written


def _at_or_below() -> Column:
    return F.col("grade") <= F.col("q")


def grade_counts(registrations: DataFrame) -> DataFrame:
    """grade, c: how often each grade was given."""
    counts = registrations.where(graded()).groupBy("grade").agg(F.count("*").alias("c"))
    return written(counts, "grade-counts")


def _sorted_counts(pairs: DataFrame, amount: str) -> DataFrame:
    return pairs.groupBy("q").agg(F.expr(amount).alias("n")).orderBy("q")


def cumulative_counts(registrations: DataFrame, points: DataFrame) -> DataFrame:
    """q, n by a theta-join of the grade counts with the points as they are."""
    pairs = theta_join(grade_counts(registrations), points, _at_or_below())
    return _sorted_counts(pairs, "sum(c)")


def cumulative_counts_reduced(registrations: DataFrame, points: DataFrame) -> DataFrame:
    """q, n with the points counted too: for long lists with many equal points."""
    times = points.groupBy("q").agg(F.count("*").alias("times"))
    pairs = theta_join(grade_counts(registrations), times, _at_or_below())
    return _sorted_counts(pairs, "sum(c * times)")


def cumulative_counts_on_grid(
    registrations: DataFrame,
    points: DataFrame,
    *,
    rows: int = GRID,
    cols: int = GRID,
    seed: int = 0,
) -> DataFrame:
    """q, n with the theta-join on a grid of cells."""
    times = points.groupBy("q").agg(F.count("*").alias("times"))
    pairs = grid_join(
        grade_counts(registrations),
        times,
        _at_or_below(),
        rows=rows,
        cols=cols,
        left_key=["grade"],
        right_key=["q"],
        seed=seed,
    )
    return _sorted_counts(pairs, "sum(c * times)")


def cumulative_counts_on_pruned_grid(registrations: DataFrame, points: DataFrame) -> DataFrame:
    """q, n with the theta-join on a grid without the cells whose grades all exceed their points."""
    times = points.groupBy("q").agg(F.count("*").alias("times"))
    pairs = pruned_grid_join(
        grade_counts(registrations),
        written(times, "point-counts"),
        "grade",
        "q",
        compared("<="),
        left_key=["grade"],
        right_key=["q"],
    )
    return _sorted_counts(pairs, "sum(c * times)")


def cumulative_counts_by_rank(registrations: DataFrame, points: DataFrame) -> DataFrame:
    """q, n from one sorted sequence of the grades and points, without a join of the two."""
    return counts_by_rank(registrations, points, "grade", "q").orderBy("q")
