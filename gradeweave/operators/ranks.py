"""Running sums over any number of rows in order, and what they give: ranks and counts.

A window over a whole table, or over a key with a third of it, is one task. Here each key's
values are cut into blocks at splitters that are drawn from the values themselves, the blocks
are summed apart, and only their totals meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a block, on average.
BLOCK_ROWS = 200_000

_BLOCK = "_block"
_SPLITTERS = "_splitters"


def place_among(splitters: Column, value: Column) -> Column:
    """How many elements of a sorted array are at or below the value, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(splitters) + 1)).cast("int"))
    whole = F.struct(F.lit(0).alias("low"), F.size(splitters).alias("high"))

    def halved(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = ((low + high) / 2).cast("int")
        behind = F.get(splitters, middle) <= value
        return F.when(low >= high, range_).otherwise(
            F.struct(
                F.when(behind, middle + 1).otherwise(low).alias("low"),
                F.when(behind, high).otherwise(middle).alias("high"),
            )
        )

    return F.aggregate(steps, whole, halved, lambda range_: range_["low"])


def running_sums(
    rows: DataFrame,
    value: str,
    weight: str,
    *,
    by: Sequence[str] = (),
    name: str = "before",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows, with the sum of ``weight`` over the rows of smaller ``value``.

    Sums run apart for each combination of the ``by`` columns, in which a value may stand once
    (sum equal ones first). Nulls of ``by`` are one key. One row in ``block_rows`` is drawn
    as a splitter, by a hash, so each plan and each run of a task cuts alike. A row finds its
    block by halving; rows are then moved once, to the other rows of their block. The splitters
    of one key, and its blocks' totals, meet in one task: a key of 10^11 rows has half a million.
    """
    by = list(by)
    chosen = F.pmod(F.xxhash64(*by, value), F.lit(block_rows)) == 0
    splitters = (
        rows.where(chosen)
        .groupBy(*[F.col(key).alias(f"_of_{key}") for key in by])
        .agg(F.sort_array(F.collect_list(value)).alias(_SPLITTERS))
    )
    if by:
        cut = _joined(rows, splitters, by, "left")
    else:
        cut = rows.withColumn(_SPLITTERS, splitters.scalar())
    block = F.when(F.col(_SPLITTERS).isNull(), 0).otherwise(
        place_among(F.col(_SPLITTERS), F.col(value))
    )
    blocked = cut.select(*rows.columns, block.alias(_BLOCK))
    earlier = Window.partitionBy(*[f"_of_{key}" for key in by]).orderBy(f"_of_{_BLOCK}")
    behind = Window.unboundedPreceding, -1
    totals = (
        blocked.groupBy(*[F.col(key).alias(f"_of_{key}") for key in [*by, _BLOCK]])
        .agg(F.sum(weight).alias("_total"))
        .withColumn("_total", F.sum("_total").over(earlier.rowsBetween(*behind)))
    )
    within = Window.partitionBy(*by, _BLOCK).orderBy(value).rowsBetween(*behind)
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("_total", zero) + F.coalesce(F.sum(weight).over(within), zero)
    return _joined(blocked, totals, [*by, _BLOCK], "inner").select(
        *rows.columns, total.alias(name)
    )


def _joined(rows: DataFrame, few: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Joined on the keys of ``few``, which are named ``_of_`` theirs; null equals null."""
    on = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return rows.join(few, on, how)


# The comparisons of a left value with a right one that can be counted by rank.
_OPERATORS = ("<=", "<", ">=", ">")


def counts_by_rank(
    left: DataFrame,
    right: DataFrame,
    left_value: str,
    right_value: str,
    operator: str = "<=",
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``right_value``, n: the pairs of the inequality join of two tables, counted per value.

    A pair is a row of each side with ``left_value operator right_value``; no pair is built.
    Both sides are counted per value and merged into one sorted sequence, in which the rows of
    the left side are summed up: n log n work, one row per distinct value moved, no copies.
    Values without a pair have no row, nulls neither; equal right rows multiply.
    """
    if operator not in _OPERATORS:
        raise ValueError(f"operator must be one of {', '.join(_OPERATORS)}")

    def side(df: DataFrame, column: str, lefts: int, rights: int) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(
            F.col(column).alias("value"), F.lit(lefts).alias("lefts"), F.lit(rights).alias("rights")
        )

    counted = (
        side(left, left_value, 1, 0)
        .unionByName(side(right, right_value, 0, 1))
        .groupBy("value")
        .agg(F.sum("lefts").alias("lefts"), F.sum("rights").alias("rights"))
    )
    summed = running_sums(counted, "value", "lefts", block_rows=block_rows)
    below = F.col("before")
    if operator in ("<=", ">"):
        below = below + F.col("lefts")
    if operator in (">=", ">"):
        below = left.agg(F.count(left_value)).scalar() - below
    pairs = (below * F.col("rights")).alias("n")
    return summed.select(F.col("value").alias(right_value), pairs).where(F.col("n") > 0)
