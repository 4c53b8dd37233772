"""Inequality and band joins on a grid without the cells that cannot hold a pair.

A plain grid copies each row to all cells of its row or column, whatever its value. Here both
sides are cut into ranges of about equally many rows (equi-depth histograms), and a cell is one
range of each side. From the least and greatest value of both ranges it is known whether a cell
can hold a pair at all; only such cells are made, in the manner of the M-Bucket scheme of Okcan
and Riedewald (SIGMOD 2011). A cell is cut again until its rows and the pairs it is expected to
give are within bounds, so one value with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from math import inf, isfinite, nextafter
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, FractionalType, NumericType, TimestampNTZType, TimestampType

from gradeweave.operators.theta import place
from gradeweave.sources.shared import written

# Quantiles of a side. It has at most twice as many ranges, a table of cells the square of that in
# rows: 263 000 of sixteen bytes.
RANGES = 256

# Rows of one side that should meet in a cell, and the pairs that a cell should give.
CELL_ROWS = 1_000_000
CELL_PAIRS = 1_000_000_000

# Rows are placed within their range by a draw from so many.
_DRAWS = 1 << 20


class Bounds(NamedTuple):
    """Whether two values are a pair, and what the ranges around them tell."""

    holds: Callable[[Column, Column], Column]
    possible: Callable[[Column, Column, Column, Column], Column]
    certain: Callable[[Column, Column, Column, Column], Column]
    band: tuple[float, float] | None = None  # the least and greatest right - left


# Of the least and greatest left value, then of the least and greatest right value.
_COMPARED = {
    "<=": Bounds(
        lambda a, b: a <= b, lambda a, z, b, y: a <= y, lambda a, z, b, y: z <= b
    ),
    "<": Bounds(lambda a, b: a < b, lambda a, z, b, y: a < y, lambda a, z, b, y: z < b),
    ">=": Bounds(
        lambda a, b: a >= b, lambda a, z, b, y: z >= b, lambda a, z, b, y: a >= y
    ),
    ">": Bounds(lambda a, b: a > b, lambda a, z, b, y: z > b, lambda a, z, b, y: a > y),
}


def compared(operator: str) -> Bounds:
    """Pairs with ``left operator right``."""
    if operator not in _COMPARED:
        raise ValueError(f"operator must be one of {', '.join(_COMPARED)}")
    return _COMPARED[operator]


def within(low: float, high: float) -> Bounds:
    """Pairs with ``left + low <= right <= left + high``, for numbers; NaN is in no pair.

    Both bounds are finite, and a value with a bound added must fit its type.
    """
    if not (isfinite(low) and isfinite(high) and low <= high):
        raise ValueError("low and high must be finite, low at most high")
    return Bounds(
        lambda a, b: (b >= a + low) & (b <= a + high),
        lambda a, z, b, y: (y >= a + low) & (b <= z + high),
        lambda a, z, b, y: (b >= z + low) & (y <= a + high),
        (low, high),
    )


class PrunedGrid(NamedTuple):
    """Where the rows of two sides meet.

    ``cells``, one row for each that can hold a pair: left_range, right_range, left_rows,
    right_rows, pairs (as expected), left_parts, right_parts (how it is cut). ``left`` and
    ``right`` are the rows of each side with the range of their value, ``_left_range`` and
    ``_right_range``.
    """

    cells: DataFrame
    left: DataFrame
    right: DataFrame

    def copies(self) -> DataFrame:
        """One row: cells, left_copies, right_copies (rows that are moved, copies included) and
        most_rows (of one side, that meet in one cell, as expected)."""
        in_part = F.greatest(
            F.col("left_rows") / F.col("left_parts"), F.col("right_rows") / F.col("right_parts")
        )
        zero = F.lit(0).cast("bigint")
        return self.cells.agg(
            F.coalesce(F.sum(F.col("left_parts") * F.col("right_parts")), zero).alias("cells"),
            F.coalesce(F.sum(F.col("left_rows") * F.col("right_parts")), zero).alias("left_copies"),
            F.coalesce(F.sum(F.col("right_rows") * F.col("left_parts")), zero).alias("right_copies"),
            F.coalesce(F.ceil(F.max(in_part)), zero).alias("most_rows"),
        )


def _number(df: DataFrame, value: str) -> Column:
    """The value as a double, in the same order (nearby values may become equal)."""
    kind = df.schema[value].dataType
    if isinstance(kind, NumericType):
        return F.col(value).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(value).cast("timestamp")).cast("double")
    raise ValueError(f"{value} must be a number, a date or a timestamp")


def _splits(quantiles: list[float]) -> list[float]:
    """Where ranges begin; a quantile that comes again is a frequent value, with its own range."""
    times = Counter(q for q in quantiles if isfinite(q))
    behind = [nextafter(q, inf) for q, n in times.items() if n > 1]
    return [-inf, *sorted({*times, *behind} - {inf}), inf]


def _histogram(df: DataFrame, value: str, ranges: int, side: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the range of their value, and for each range that has rows: its number, rows,
    least and greatest value. Ranges are of about equally many rows; a value with two quantiles
    or more has a range of its own."""
    name, number = f"_{side}_range", "_number"
    numbered = df.withColumn(number, _number(df, value))
    shares = [i / ranges for i in range(1, ranges)]
    # Fewer than RANGES numbers.
    cut = shares and numbered.agg(F.percentile_approx(number, shares, 100 * ranges)).first()[0]
    splits = _splits(cut or [])
    ranged = df.withColumn(name, F.lit(0))
    if len(splits) > 2:
        bucketizer = Bucketizer(
            splits=splits, inputCol=number, outputCol=name, handleInvalid="keep"
        )
        range_ = F.col(name).cast("int").alias(name)
        ranged = bucketizer.transform(numbered).select(*df.columns, range_)
    depth = ranged.groupBy(F.col(name).alias(f"{side}_range")).agg(
        F.count("*").alias(f"{side}_rows"),
        F.min(value).alias(f"{side}_least"),
        F.max(value).alias(f"{side}_greatest"),
    )
    return ranged, depth


def _share(bounds: Bounds, ends: Sequence[Column]) -> Column:
    """The share of a cell's pairs that is expected to match."""
    some = F.lit(0.5)
    if bounds.band:
        low, high = bounds.band
        a, z, b, y = (end.cast("double") for end in ends)
        some = F.least(F.lit(1.0), F.lit(high - low or 1.0) / F.greatest(z - a, y - b))
    return F.when(bounds.certain(*ends), 1.0).otherwise(some)


def pruned_grid(
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    right_value: str,
    bounds: Bounds,
    *,
    ranges: int = RANGES,
    cell_rows: int = CELL_ROWS,
    cell_pairs: int = CELL_PAIRS,
) -> PrunedGrid:
    """The cells for two sides without null values; see ``pruned_grid_join``.

    The histograms are exact: approximate quantiles choose where ranges begin, then each range's
    rows are counted and its ends taken. A cell that can hold a pair but need not is expected to
    give half of all its pairs, or in a band join the band's share of its span. The table of cells is written, so all tasks cut alike.
    """
    left_ranged, left_depth = _histogram(left, left_value, ranges, "left")
    right_ranged, right_depth = _histogram(right, right_value, ranges, "right")
    ends = [F.col(f"{side}_{end}") for side in ("left", "right") for end in ("least", "greatest")]
    left_rows, right_rows = F.col("left_rows"), F.col("right_rows")
    pairs = left_rows.cast("double") * right_rows * _share(bounds, ends)

    def parts(rows: str) -> Column:
        return F.ceil(F.col(rows) / cell_rows)

    # Cut both sides alike until the expected pairs fit too, into no more parts than rows.
    in_part = F.col("pairs") / (parts("left_rows") * parts("right_rows"))
    over = F.sqrt(F.greatest(F.lit(1.0), in_part / cell_pairs))
    cells = (
        left_depth.join(F.broadcast(right_depth), bounds.possible(*ends))
        .withColumn("pairs", pairs)
        .select(
            "left_range",
            "right_range",
            "left_rows",
            "right_rows",
            "pairs",
            *[
                F.least(F.col(rows), F.ceil(parts(rows) * over)).cast("int").alias(name)
                for rows, name in (("left_rows", "left_parts"), ("right_rows", "right_parts"))
            ],
        )
    )
    return PrunedGrid(written(cells, "grid-cells"), left_ranged, right_ranged)


def pruned_grid_join(
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    right_value: str,
    bounds: Bounds,
    condition: Column | None = None,
    *,
    ranges: int = RANGES,
    cell_rows: int = CELL_ROWS,
    cell_pairs: int = CELL_PAIRS,
    left_key: Sequence[str] = (),
    right_key: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """Inner join of whole rows, with bag semantics, on values that ``bounds`` makes a pair
    (and on ``condition``, if given). The sides share no column name.

    Each pair meets in exactly one cell. Rows of null value are in no pair; an empty side gives
    no row. A row is copied once for each part of the other side in the cells its range has, not
    once for each cell of a whole grid row: a band join of sorted-alike sides copies most rows
    two or three times, however large they are. ``left_key`` and ``right_key`` are as in
    ``grid_join``: rows are placed by their hash, without them by a draw that is checkpointed.
    Each side is read three times: for its quantiles, its histogram and the join.
    """
    sides = []
    for side, value in ((left, left_value), (right, right_value)):
        present = F.col(value).isNotNull()
        if bounds.band and isinstance(side.schema[value].dataType, FractionalType):
            present = present & ~F.isnan(value)
        sides.append(side.where(present))
    left, right = sides
    grid = pruned_grid(
        left,
        right,
        left_value,
        right_value,
        bounds,
        ranges=ranges,
        cell_rows=cell_rows,
        cell_pairs=cell_pairs,
    )
    placed_left = _in_cells(grid.left, grid.cells, "left", "right", left_key, seed)
    placed_right = _in_cells(grid.right, grid.cells, "right", "left", right_key, seed + 1)
    cell = ["_left_range", "_right_range", "_left_part", "_right_part"]
    if bounds.band:
        low, high = bounds.band
        cell.append("_bin")
        first, last = (_bin(F.col(left_value) + by, high - low) for by in bounds.band)
        placed_left = placed_left.withColumn("_bin", F.explode(F.sequence(first, last)))
        placed_right = placed_right.withColumn("_bin", _bin(F.col(right_value), high - low))
    pairs = placed_left.hint("merge").join(placed_right, cell)
    pairs = pairs.where(bounds.holds(F.col(left_value), F.col(right_value)))
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.drop(*cell)


def _bin(value: Column, width: float) -> Column:
    """The bin of a value; a band that begins and ends at values reaches over the bins between
    theirs, most often two. Rounding keeps the order, so no pair is lost."""
    return F.floor(value.cast("double") / (width or 1.0))


def _in_cells(
    ranged: DataFrame, cells: DataFrame, side: str, other: str, key: Sequence[str], seed: int
) -> DataFrame:
    """Each row once for each cell part it is needed in."""
    own, draw = f"_{side}_range", "_draw"
    # Four numbers a row, and no more rows than said at RANGES.
    few = F.broadcast(
        cells.select(
            *[
                F.col(f"{of}_{what}").alias(f"_{of}_{what}")
                for of in ("left", "right")
                for what in ("range", "parts")
            ]
        )
    )
    part = F.floor(F.col(draw) * F.col(f"_{side}_parts") / _DRAWS).cast("int")
    copies = F.sequence(F.lit(0), F.col(f"_{other}_parts") - 1)
    return place(ranged, draw, _DRAWS, key, seed).join(few, own).select(
        *[name for name in ranged.columns if name != own],
        "_left_range",
        "_right_range",
        part.alias(f"_{side}_part"),
        F.explode(copies).alias(f"_{other}_part"),
    )
