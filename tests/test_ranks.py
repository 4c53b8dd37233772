"""Running sums in blocks, and inequality joins counted by rank."""

import random
from collections import Counter
from operator import ge, gt, le, lt

import pytest
from compare import plan_of, rows_of
from pyspark.sql import functions as F

from gradeweave.operators.grouping import value_lists
from gradeweave.operators.ranks import counts_by_rank, place_among, running_sums
from gradeweave.operators.theta import grid_join


def test_place_among(spark):
    rows = [([], 3), ([1, 1, 4, 9], 0), ([1, 1, 4, 9], 1), ([1, 1, 4, 9], 8), ([1, 1, 4, 9], 9)]
    df = spark.createDataFrame(rows, "s array<int>, v int")
    found = df.select(place_among(F.col("s"), F.col("v"))).collect()
    assert [row[0] for row in found] == [0, 0, 2, 3, 4]


@pytest.mark.parametrize("block_rows", [1, 3, 1_000_000])
def test_running_sums(spark, block_rows):
    rng = random.Random(4)
    rows = [
        (key, f"v{i:03}", rng.randrange(5)) for key in ("a", None) for i in rng.sample(range(300), 90)
    ]
    df = spark.createDataFrame(rows, "k string, v string, w long")
    expected = {
        (key, v, w, sum(x[2] for x in rows if x[0] == key and x[1] < v)) for key, v, w in rows
    }
    found = running_sums(df, "v", "w", by=["k"], block_rows=block_rows)
    assert set(map(tuple, found.collect())) == expected and found.count() == len(rows)
    whole = running_sums(df.where("k = 'a'"), "v", "w", block_rows=block_rows)
    assert set(map(tuple, whole.collect())) == {row for row in expected if row[0] == "a"}


def test_running_sums_of_nothing(spark):
    df = spark.createDataFrame([], "v int, w long")
    assert running_sums(df, "v", "w").count() == 0


@pytest.mark.parametrize("operator,holds", [("<=", le), ("<", lt), (">=", ge), (">", gt)])
@pytest.mark.parametrize("block_rows", [2, 1_000_000])
def test_counts_by_rank(spark, operator, holds, block_rows):
    rng = random.Random(operator)
    # One value has a third of the left rows, another a third of the right ones.
    lefts = [rng.choice([7, rng.randrange(40), None]) for _ in range(200)]
    rights = [rng.choice([21, rng.randrange(-5, 45), None]) for _ in range(150)]
    left = spark.createDataFrame([(x,) for x in lefts], "a int")
    right = spark.createDataFrame([(x,) for x in rights], "b int")
    pairs = Counter(
        b for b in rights for a in lefts if a is not None and b is not None and holds(a, b)
    )
    found = counts_by_rank(left, right, "a", "b", operator, block_rows=block_rows)
    assert found.columns == ["b", "n"]
    assert rows_of(found) == sorted(pairs.items())
    on_grid = grid_join(left, right, F.expr(f"a {operator} b"), rows=3, cols=2)
    assert rows_of(on_grid.groupBy("b").count()) == sorted(pairs.items())


def test_counts_by_rank_move_counts_not_pairs(spark):
    left = spark.range(100_000).select((F.col("id") % 5000).alias("a"))
    right = spark.range(100_000).select((F.col("id") % 7000).alias("b"))
    found = counts_by_rank(left, right, "a", "b", block_rows=500)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.agg(F.sum("n")).first()[0] == sum(
        20 * min(b + 1, 5000) * (15 if b < 2000 else 14) for b in range(7000)
    )


def test_counts_of_nothing(spark):
    none = spark.createDataFrame([], "a int")
    some = spark.createDataFrame([(1,), (None,)], "b int")
    for operator in ("<=", ">"):
        assert counts_by_rank(none, some, "a", "b", operator).count() == 0
        assert counts_by_rank(some, none, "b", "a", operator).count() == 0
    with pytest.raises(ValueError, match="operator"):
        counts_by_rank(none, some, "a", "b", "=")


@pytest.mark.parametrize("length", [1, 4, 100, 100_000])
@pytest.mark.parametrize("limit,block_rows", [(0, 2), (1 << 20, 50)])
def test_parts_of_value_lists_are_consecutive(spark, length, limit, block_rows):
    values = {1: [f"v{i % 70:02}" for i in range(297)], None: ["b", "a"] * 3, 3: ["x"] * 250}
    rows = [(key, value) for key, several in values.items() for value in several]
    df = spark.createDataFrame([*rows, (4, None), (1, None)], "k int, v string").repartition(4)
    lists = value_lists(df, "k", "v", length=length, limit=limit, block_rows=block_rows)
    found = {(row["k"], row["part"]): row["values"] for row in lists.collect()}
    assert lists.count() == len(found)
    assert found == {
        (key, i // length): sorted(several)[i : i + length]
        for key, several in values.items()
        for i in range(0, len(several), length)
    }
