"""Joins on any condition, spread evenly over a grid when neither side is small.

The grid follows the 1-Bucket-Theta scheme of Okcan and Riedewald (SIGMOD 2011). A left
row takes one grid row and is copied to each of its cells, a right row takes one column
and is copied to each of its cells. Every pair of rows meets in exactly one cell, so the
result does not depend on the placement. |L| * cols + |R| * rows rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.placement import hashed_cell, random_cell
from gradeweave.operators.sizes import BROADCAST_BYTES, is_small, measure
from gradeweave.sources.shared import enable_checkpoints

# Fixed value: cells per grid axis when nothing else decides it.
GRID = 6

CELL_BYTES = 128 * 1024 * 1024

_ROW = "_grid_row"
_COLUMN = "_grid_column"


def theta_join(
    left: DataFrame,
    right: DataFrame,
    condition: Column | None = None,
    *,
    on: Sequence[str] = (),
    limit: int = BROADCAST_BYTES,
    left_key: Sequence[str] = (),
    right_key: Sequence[str] = (),
) -> DataFrame:
    """Inner join on ``condition`` and/or equal ``on`` columns, with bag semantics.

    A side measured to be within ``limit`` bytes is broadcast. When both are larger, the
    join runs on a grid whose cells hold about ``CELL_BYTES`` of each side.
    """
    right_size = measure(right)
    if is_small(right_size, limit):
        return _matching(left, F.broadcast(right), on, condition)
    left_size = measure(left)
    if is_small(left_size, limit):
        return _matching(F.broadcast(left), right, on, condition)
    return grid_join(
        left,
        right,
        condition,
        on=on,
        rows=_cells(left_size.bytes),
        cols=_cells(right_size.bytes),
        left_key=left_key,
        right_key=right_key,
    )


def grid_join(
    left: DataFrame,
    right: DataFrame,
    condition: Column | None = None,
    *,
    on: Sequence[str] = (),
    rows: int = GRID,
    cols: int = GRID,
    left_key: Sequence[str] = (),
    right_key: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """The same join on a grid of ``rows`` x ``cols`` cells.

    ``left_key`` / ``right_key`` name columns whose values tell a side's rows apart; the
    rows are then placed by their hash. Without them the place is drawn at random, which
    also splits groups of equal rows, and the drawn places are checkpointed: a lost
    executor must not lead to a second draw after other cells have used the first.

    A merge join is asked for: without it the planner may broadcast a side by its file size,
    and a hash join would hold a whole cell, while the sort spills. What a merge join does
    hold is one cell's rows of ``right``, so that should be the smaller side.
    """
    placed_left = place(left, _ROW, rows, left_key, seed)
    placed_right = place(right, _COLUMN, cols, right_key, seed + 1)
    return _matching(
        _copy(placed_left, _COLUMN, cols).hint("merge"),
        _copy(placed_right, _ROW, rows),
        [*on, _ROW, _COLUMN],
        condition,
    ).drop(_ROW, _COLUMN)


def _matching(
    left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column | None
) -> DataFrame:
    if condition is None:
        return left.join(right, list(on))
    if not on:
        return left.join(right, condition)
    return left.join(right, list(on)).where(condition)


def place(df: DataFrame, axis: str, k: int, key: Sequence[str], seed: int) -> DataFrame:
    """The rows with a place in [0, k): by the hash of the key, else drawn and checkpointed."""
    if key:
        return df.withColumn(axis, hashed_cell(k, key, seed))
    enable_checkpoints(df.sparkSession)
    return df.withColumn(axis, random_cell(k, seed)).checkpoint()


def _copy(df: DataFrame, axis: str, k: int) -> DataFrame:
    return df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def _cells(size: int) -> int:
    return max(1, ceil(size / CELL_BYTES))
