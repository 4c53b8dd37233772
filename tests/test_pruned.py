"""Joins on a grid without the cells that cannot hold a pair."""

import datetime
import random
from operator import ge, gt, le, lt

import pytest
from compare import plan_of, rows_of
from pyspark.sql import functions as F

from gradeweave.operators.pruned import compared, pruned_grid, pruned_grid_join, within
from gradeweave.operators.theta import grid_join

HOLDS = {"<=": le, "<": lt, ">=": ge, ">": gt}
SIZES = [{}, {"ranges": 9, "cell_rows": 7, "cell_pairs": 10}]


def sides(spark, seed):
    """One value has a third of the left rows, another a third of the right ones."""
    rng = random.Random(seed)
    lefts = [rng.choice([7, rng.randrange(40), rng.choice([None, 3])]) for _ in range(200)]
    rights = [rng.choice([21, rng.randrange(-5, 45), rng.choice([None, 9])]) for _ in range(150)]
    left = spark.createDataFrame([(x, i) for i, x in enumerate(lefts)], "a int, i int")
    right = spark.createDataFrame([(x, i) for i, x in enumerate(rights)], "b int, j int")
    pairs = [
        (a, i, b, j)
        for i, a in enumerate(lefts)
        for j, b in enumerate(rights)
        if a is not None and b is not None
    ]
    return left, right, pairs


@pytest.mark.parametrize("operator", list(HOLDS))
@pytest.mark.parametrize("size", SIZES)
def test_comparisons(spark, operator, size):
    left, right, pairs = sides(spark, operator)
    found = pruned_grid_join(
        left, right, "a", "b", compared(operator), left_key=["i"], right_key=["j"], **size
    )
    assert found.columns == ["a", "i", "b", "j"]
    assert rows_of(found) == sorted(p for p in pairs if HOLDS[operator](p[0], p[2]))


@pytest.mark.parametrize("low,high", [(-2, 3), (0, 0), (10, 12)])
@pytest.mark.parametrize("size", SIZES)
def test_bands(spark, low, high, size):
    left, right, pairs = sides(spark, low)
    found = pruned_grid_join(left, right, "a", "b", within(low, high), **size)
    assert rows_of(found) == sorted(p for p in pairs if p[0] + low <= p[2] <= p[0] + high)


def test_repeated_rows_and_a_further_condition(spark):
    left = spark.createDataFrame([(1, "x")] * 50 + [(2, "y")] * 3, "a int, s string")
    right = spark.createDataFrame([(1, "x")] * 40 + [(3, "y")] * 2, "b int, t string")
    found = pruned_grid_join(
        left, right, "a", "b", compared("<="), F.expr("s = t"), ranges=4, cell_rows=5
    )
    assert rows_of(found.groupBy("s").count()) == [("x", 2000), ("y", 6)]


def test_nan_infinity_dates_and_types(spark):
    odd = [1.5, float("nan"), float("inf"), float("-inf"), None, -0.0]
    left = spark.createDataFrame([(x,) for x in odd], "a double")
    right = left.withColumnRenamed("a", "b")
    for operator in HOLDS:
        found = pruned_grid_join(left, right, "a", "b", compared(operator), ranges=3)
        plain = left.join(right, F.expr(f"a {operator} b"))
        assert found.selectExpr("string(a)", "string(b)").exceptAll(
            plain.selectExpr("string(a)", "string(b)")
        ).isEmpty()
        assert found.count() == plain.count()
    near = pruned_grid_join(left, right, "a", "b", within(-2, 2), ranges=3).collect()
    inf = float("inf")
    assert {tuple(row) for row in near} == {
        (1.5, 1.5), (1.5, 0.0), (0.0, 1.5), (0.0, 0.0), (inf, inf), (-inf, -inf)
    }
    days = [(datetime.date(2020, 1, d),) for d in (1, 5, 9)]
    a, b = spark.createDataFrame(days, "a date"), spark.createDataFrame(days, "b date")
    assert pruned_grid_join(a, b, "a", "b", compared("<"), ranges=2).count() == 3
    text = spark.createDataFrame([("x",)], "b string")
    with pytest.raises(ValueError, match="must be a number"):
        pruned_grid_join(left, text, "a", "b", compared("<"))
    with pytest.raises(ValueError, match="operator"):
        compared("=")
    with pytest.raises(ValueError, match="finite"):
        within(0, inf)
    with pytest.raises(ValueError, match="finite"):
        within(2, 1)


def test_empty_sides(spark):
    some = spark.createDataFrame([(1,), (None,)], "a int")
    none = spark.createDataFrame([], "b int")
    for left, right, a, b in ((some, none, "a", "b"), (none, some, "b", "a")):
        for bounds in (compared("<="), within(-1, 1)):
            assert pruned_grid_join(left, right, a, b, bounds).count() == 0
            assert pruned_grid(left, right, a, b, bounds).copies().first()["cells"] == 0


def test_copies_are_few_where_few_cells_can_match(spark):
    """Two skewed sides: a third of each has one value, far apart; a band of ten values."""
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("a"))
    right = spark.range(30_000).select(F.when(F.col("id") % 3 == 1, 29_000).otherwise(F.col("id")).alias("b"))
    grid = pruned_grid(left, right, "a", "b", within(0, 9), ranges=30, cell_rows=1000)
    copies = grid.copies().first()
    # A full grid of cells of 1000 rows a side copies each row 30 times.
    assert copies["left_copies"] + copies["right_copies"] < 4 * 60_000
    assert copies["most_rows"] <= 1000
    found = pruned_grid_join(
        left, right, "a", "b", within(0, 9), ranges=30, cell_rows=1000, cell_pairs=10**6
    )
    plain = left.join(right, F.expr("b between a and a + 9"))
    assert found.count() == plain.count()
    plan = plan_of(found)
    assert "SortMergeJoin" in plan and "Cartesian" not in plan


def test_expected_pairs_bound_the_parts(spark):
    left = spark.range(2000).select(F.lit(1).alias("a"))
    right = spark.range(3000).select(F.lit(2).alias("b"))
    bounded = pruned_grid(left, right, "a", "b", compared("<"), ranges=4, cell_pairs=60_000)
    (cell,) = bounded.cells.collect()
    assert cell["pairs"] == 6_000_000
    assert 100 <= cell["left_parts"] * cell["right_parts"] <= 121
    same = grid_join(left, right, F.expr("a < b"), rows=2, cols=2)
    found = pruned_grid_join(left, right, "a", "b", compared("<"), ranges=1, cell_pairs=60_000)
    assert found.count() == same.count() == 6_000_000
