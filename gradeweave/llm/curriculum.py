"""Training positions from weight schedules of sources that change over time.

Each source gets a target number of tokens and a schedule: its weight over training time 0 to
1, linear between knots. The integral of the schedule, scaled to the target, is the source's
cumulative demand. A source's documents stand in a fixed order and supply tokens one after
the other, over and over until the target is met; the inverse of the demand at a document's
first token is its position. All of this is column arithmetic: the running sums are taken
per source and slice of the order, so a source with a third of all rows is spread over all
slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.llm.text import word_count
from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast
from gradeweave.sources.shared import written

# Slices of a source's order: 16 ** DIGITS.
DIGITS = 3

# Weights of sources in order of their names, repeating; share of all tokens that the mix
# takes; and how often a document is taken at most.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2

# Weight at times 0, 1/2 and 1 relative to the source's own, for the sources of each weight:
# the heaviest are most wanted at first, the lightest towards the end. Each integral is 1.
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and key, the place in the source's order."""
    return docs.select(
        "doc_id",
        "source",
        word_count("text").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
    )


def targets(
    sizes: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """source, source_size, rank (0 for the first in code point order, null last), target.

    One row per source. Targets share ``share`` of all tokens by weight, up to ``repeats``
    times the source's size; what exceeds that goes to the others by weight. Sources are
    filled up in order of size over weight: once one is not full, no later one is.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    # Few rows, one per source, from here on.
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
        .withColumn("cap", F.col("source_size") * repeats)
    )
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("source_size").over(everything) * F.lit(float(share))
    left = whole - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(onward)
    open_level = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    return (
        sources.withColumn("level", level)
        # The first source that is not filled up sets the level for itself and those after it.
        .withColumn("level", F.first(open_level, ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select(
            "source", "source_size", "rank",
            F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
            .alias("target"),
        )
    )


def inverse(share: Column, shape: Column) -> Column:
    """The time at which a schedule has met this share of its demand.

    ``shape`` holds the weights at evenly spaced times from 0 to 1. Within a segment the
    demand is a quadratic, whose root is taken in the form that needs no division by a
    slope, so constant weights are no special case.
    """

    def step(state: Column, i: Column) -> Column:
        low, high = F.get(shape, i), F.get(shape, i + 1)
        area = (low + high) / 2
        rest = state["rest"]
        root = F.sqrt(F.greatest(low * low + (high - low) * 2 * rest, F.lit(0.0)))
        inside = F.least(F.coalesce(F.try_divide(rest * 2, low + root), F.lit(0.0)), F.lit(1.0))
        return F.struct(
            F.when(rest >= area, rest - area).otherwise(F.lit(0.0)).alias("rest"),
            (state["time"] + F.when(rest >= area, 1.0).otherwise(inside) * state["open"])
            .alias("time"),
            F.when(rest >= area, state["open"]).otherwise(F.lit(0.0)).alias("open"),
        )

    segments = F.size(shape) - 1
    total = F.aggregate(
        F.sequence(F.lit(0), segments - 1),
        F.lit(0.0),
        lambda sum_, i: sum_ + (F.get(shape, i) + F.get(shape, i + 1)) / 2,
    )
    start = F.struct(
        (F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * total).alias("rest"),
        F.lit(0.0).alias("time"),
        F.lit(1.0).alias("open"),
    )
    return F.aggregate(
        F.sequence(F.lit(0), segments - 1), start, step, lambda state: state["time"] / segments
    )


def scheduled(
    sizes: DataFrame,
    goals: DataFrame,
    *,
    shapes: Sequence[Sequence[float]] = SHAPES,
    digits: int = DIGITS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_position,
    positions.

    ``taken`` counts the tokens that the mix takes from the document, repeats included; the
    last one of a source may be taken in part. ``positions`` has the time in [0, 1] of
    every time it is taken, ``first_position`` the first, null where it is never taken. Null
    and empty texts have size 0 and are never taken; rows of equal doc_id are rows like any
    other, in order of size; a null source is a source.
    """
    spread = sizes.withColumn("slice", F.substring("key", 1, digits))
    per_slice = spread.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    slices = per_slice.select(
        F.col("source").alias("of_source"),
        F.col("slice").alias("of_slice"),
        F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("slice_start"),
    )
    goals = goals.select(F.col("source").alias("goal_source"), "source_size", "rank", "target")
    within = Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    numbered = spread.withColumn(
        "in_slice", F.coalesce(F.sum("size").over(within), F.lit(0))
    )
    slices = slices.join(goals, F.col("of_source").eqNullSafe(F.col("goal_source")))
    placed = numbered.join(
        slices,
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slice") == F.col("of_slice")),
    ).withColumn("start", F.col("slice_start") + F.col("in_slice"))

    wanted = F.floor(F.col("target")).cast("bigint")
    starts = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.floor(F.try_divide(wanted, F.col("source_size")))),
            lambda k: F.col("start") + k * F.col("source_size"),
        ),
        lambda start: (start < wanted) & (F.col("size") > 0),
    )
    choices = F.array(*[F.array(*[F.lit(float(x)) for x in shape]) for shape in shapes])
    shape = F.get(choices, F.col("rank") % len(shapes))
    taken = F.aggregate(
        "starts",
        F.lit(0).cast("bigint"),
        lambda sum_, start: sum_ + F.least(F.col("size"), wanted - start),
    )
    positions = F.transform("starts", lambda start: inverse(start / F.col("target"), shape))
    return (
        placed.withColumn("starts", F.coalesce(starts, F.array().cast("array<bigint>")))
        .withColumn("taken", taken)
        .withColumn("positions", positions)
        .select(
            "doc_id", "size", "source_size", "target", "taken",
            F.get("positions", F.lit(0)).alias("first_position"), "positions",
        )
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """Documents in training order: ``scheduled`` for a table with doc_id, text and source,
    range-sorted by first position; documents that are never taken come last. Other columns
    are not looked at; an empty table gives no rows."""
    return planned(docs, **options).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def planned(docs: DataFrame, **options) -> DataFrame:
    """``scheduled``, in no order."""
    sizes = written(sized(docs), "sizes")
    return scheduled(sizes, targets(sizes, **options))


def repeated(
    docs: DataFrame, plan: DataFrame, *, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """The training stream: each document as often as it is taken, in order of position.

    The columns of ``docs`` are kept, and ``position`` is added. ``plan`` is what ``planned`` gave
    for ``docs``, with one row for each of its rows. Where rows share a doc_id (or have none),
    those of one size are numbered in both, and each row takes the times of one row of the plan,
    so a row comes as often as planned and no more.
    """
    taken = plan.where(F.size("positions") > 0).select("doc_id", "size", "positions")
    shared = written(
        plan.groupBy(F.col("doc_id").alias("shared_id"))
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > 1)
        .select("shared_id"),
        "shared-ids",
    )
    if shared.isEmpty():
        return _by_position(_timed(docs, taken, [], limit))
    hint = F.broadcast(shared) if fits_broadcast(shared, limit) else shared
    of_shared = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    alone = _timed(
        docs.join(hint, of_shared, "left_anti"), taken.join(hint, of_shared, "left_anti"), [], limit
    )
    # Rows that are never taken are numbered too; they come last on the side of the plan.
    of_size = Window.partitionBy("doc_id", "_size")
    rows = docs.join(hint, of_shared, "left_semi").withColumn("_size", word_count("text"))
    rows = rows.withColumn(
        "_number", F.row_number().over(of_size.orderBy(F.xxhash64("text"), "source"))
    )
    several = (
        plan.join(hint, of_shared, "left_semi")
        .select("doc_id", F.col("size").alias("_size"), "positions")
        .withColumn("_number", F.row_number().over(of_size.orderBy(F.desc(F.size("positions")),
                                                                   "positions")))
        .where(F.size("positions") > 0)
    )
    numbered = _timed(rows, several, ["_size", "_number"], limit)
    return _by_position(alone.unionByName(numbered.drop("_size", "_number")))


def _timed(docs: DataFrame, plan: DataFrame, also: list[str], limit: int) -> DataFrame:
    """Each document with each of its positions, by doc_id (null too) and the other columns."""
    keys = ["doc_id", *also]
    times = written(
        plan.select(
            *[F.col(key).alias(f"_of_{key}") for key in keys],
            F.explode("positions").alias("position"),
        ),
        "times",
    )
    if fits_broadcast(times, limit):
        times = F.broadcast(times)
    on = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return docs.join(times, on).drop(*[f"_of_{key}" for key in keys])


def _by_position(rows: DataFrame) -> DataFrame:
    return rows.orderBy("position", "doc_id")
