"""Joins: bag semantics, hot keys, grids."""

from itertools import product

import pytest
from compare import plan_of, rows_of
from conftest import OFFERS, OFFER_SCHEMA, REGISTRATIONS
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeweave.functions.placement import hashed_cell, random_cell
from gradeweave.operators import theta
from gradeweave.operators.joins import (
    equi_join,
    first_joined_row,
    hot_keys,
    placed,
    semi_join,
)
from gradeweave.operators.sizes import Size, fits_broadcast, is_small, measure
from gradeweave.operators.theta import grid_join, theta_join


HOT_SCHEMA = "offer_id bigint, left_parts int, right_parts int"


def joined(left, right):
    """Inner join on the first column, by nested loops."""
    rows = [(*a, *b[1:]) for a, b in product(left, right) if a[0] == b[0]]
    return sorted(rows, key=lambda row: tuple((cell is not None, cell or 0) for cell in row))


def test_equi_join_keeps_equal_rows_and_drops_unmatched(offers, registrations):
    df = equi_join(offers, registrations, "offer_id")
    assert df.columns == ["offer_id", "course_id", "yr", "quartile", "student_id", "grade"]
    assert rows_of(df) == joined(OFFERS, REGISTRATIONS)
    assert df.count() == 7


@pytest.fixture(scope="module")
def skewed(spark):
    """Offer 1 has more than a third of 9000 rows, among them 2000 copies of one row."""
    rows = [(1, 7, 7)] * 2000 + [(1, i, i % 10 + 1) for i in range(1500)]
    rows += [(i % 500, i, None if i % 7 == 0 else i % 10 + 1) for i in range(5500)]
    rows += [(None, 1, 5), (None, 2, 6)]
    return spark.createDataFrame(
        rows, "offer_id bigint, student_id bigint, grade int"
    ).repartition(5), rows


@pytest.fixture(scope="module")
def many_offers(spark):
    rows = [(i, i % 9, 2000 + i % 5, i % 4 + 1) for i in range(400)] + [(1, 0, 2000, 1)] * 2
    rows += [(None, 1, 2000, 1)]
    return spark.createDataFrame(
        rows, "offer_id bigint, course_id bigint, yr int, quartile int"
    ), rows


def test_hot_keys_are_found(skewed, many_offers):
    offers, rows = many_offers[0], skewed[0]
    assert rows_of(hot_keys("offer_id", offers, rows, rows=100, look_at=1.0)) == [(1, 1, 36)]
    ((found, one, some),) = rows_of(hot_keys("offer_id", offers, rows, rows=1000, look_at=0.2))
    assert (found, one) == (1, 1) and some in (3, 4, 5)
    both = {row[0]: row[1:] for row in rows_of(hot_keys("offer_id", offers, rows, rows=3, look_at=1.0))}
    assert len(both) == 500 and both[1] == (1, 1171) and both[2] == (1, 4)
    assert rows_of(hot_keys("offer_id", offers, rows)) == []
    assert rows_of(hot_keys("offer_id", rows.limit(0), rows.limit(0))) == []


def test_any_number_of_hot_keys_is_found(spark):
    left, right = spark.range(3000).toDF("k"), spark.range(6000).selectExpr("id % 3000 AS k")
    hot = hot_keys("k", left, right, rows=2, look_at=1.0)
    assert hot.count() == 3000 and hot.where("left_parts = 1 AND right_parts = 1").count() == 3000
    assert equi_join(left, right, "k", hot=hot).count() == 6000


@pytest.mark.parametrize("n", [1, 10, 400])
def test_copies_do_not_grow_with_the_number_of_hot_keys(spark, many_offers, n):
    hot = spark.range(n).selectExpr("id AS offer_id", "2 AS own", "3 AS other")
    rows = many_offers[0].where(f"offer_id < {n}")
    copied = placed(rows, hot, "offer_id", "own", "other")
    assert copied.count() == 3 * rows.count()
    assert copied.where("own NOT IN (0, 1) OR other NOT IN (0, 1, 2)").count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["split", "plain"])
@pytest.mark.parametrize(
    "hot",
    [[(1, 1, 4)], [(1, 3, 5), (2, 1, 1), (250, 2, 1), (777, 4, 4)], []],
    ids=["one", "some", "none"],
)
def test_hot_keys_do_not_change_the_join(spark, skewed, many_offers, limit, hot):
    plain = many_offers[0].join(skewed[0], "offer_id")
    hot = spark.createDataFrame(hot, HOT_SCHEMA)
    split = equi_join(many_offers[0], skewed[0], "offer_id", hot=hot, limit=limit)
    assert split.columns == plain.columns
    assert rows_of(split) == rows_of(plain)


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "shuffle"])
@pytest.mark.parametrize("hot", [None, [(1, 1, 3)]])
def test_semi_join_counts_a_row_once(spark, registrations, limit, hot):
    hot = hot and spark.createDataFrame(hot, HOT_SCHEMA)
    offers = spark.createDataFrame([OFFERS[0], *OFFERS, (None, 1, 1, 1)], OFFER_SCHEMA)
    rows = registrations.union(spark.createDataFrame([(None, 1, 1)], registrations.schema))
    rows = rows.select("grade", "offer_id", "student_id")
    found = semi_join(rows, offers, "offer_id", hot=hot, limit=limit)
    assert found.columns == rows.columns
    expected = [row for row in REGISTRATIONS if row[0] in {1, 2, 3, 4}]
    assert rows_of(found.select("offer_id", "student_id", "grade")) == joined(
        [(row[0],) for row in OFFERS], expected
    )


def test_first_joined_row(spark, offers, registrations, skewed, many_offers):
    assert rows_of(first_joined_row(offers, registrations, "offer_id")) == [
        (1, 10, 2016, 2, 3, None)
    ]
    first = first_joined_row(many_offers[0], skewed[0], "offer_id")
    plain = many_offers[0].join(skewed[0], "offer_id")
    order = [F.col(name).asc_nulls_first() for name in plain.columns]
    assert rows_of(first) == rows_of(plain.orderBy(*order).limit(1))


def test_first_joined_row_ignores_null_keys_and_unshared_ones(spark):
    left = spark.createDataFrame([(None, 1), (1, 5), (3, 8), (3, 7), (4, 0)], "k int, a int")
    right = spark.createDataFrame([(None, 2), (2, 5), (3, 9), (3, None), (4, 0)], "k int, b int")
    assert rows_of(first_joined_row(left, right, "k")) == [(3, 7, None)]


def test_first_joined_row_of_an_empty_join(offers, registrations):
    assert rows_of(first_joined_row(offers, registrations.where("offer_id = 99"), "offer_id")) == []
    assert rows_of(first_joined_row(offers.limit(0), registrations, "offer_id")) == []


def test_measured_sizes(spark):
    numbers = spark.range(10)
    assert measure(numbers) == Size(10, 10 * 24)
    texts = spark.createDataFrame([("abc",), ("",), (None,), ("é",)], "t string")
    assert measure(texts) == Size(4, 4 * 32 + 5)
    assert measure(texts.limit(0)) == Size(0, 0)
    lists = spark.createDataFrame([([1],)], "a array<int>")
    assert measure(lists) == Size(1, 32 + len('{"a":[1]}'))
    assert is_small(measure(lists), 41) and not is_small(measure(lists), 40)
    assert fits_broadcast(numbers, 240) and not fits_broadcast(numbers, 239)


def test_grid_of_nested_columns_follows_their_size(spark, monkeypatch):
    monkeypatch.setattr(theta, "CELL_BYTES", 10_000)
    lists = spark.range(100).selectExpr("id AS x", "array_repeat(id, 50) AS values")
    cells = {n: theta._cells(measure(lists.limit(n)).bytes) for n in (1, 100)}
    assert cells[1] == 1 and cells[100] >= 2
    other = lists.selectExpr("x AS y", "values AS others")
    found = theta_join(lists, other, F.col("x") < F.col("y"), limit=0, left_key=["x"], right_key=["y"])
    assert found.count() == 100 * 99 // 2


small = st.integers(-3, 12)
grids = st.tuples(st.integers(1, 6), st.integers(1, 6))


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    left=st.lists(small, max_size=25),
    right=st.lists(small, max_size=12),
    grid=grids,
    seed=st.integers(0, 1000),
    keyed=st.booleans(),
)
def test_grid_gives_every_pair_once(spark, left, right, grid, seed, keyed):
    a = spark.createDataFrame(list(enumerate(left)), "i int, x int")
    b = spark.createDataFrame(list(enumerate(right)), "j int, y int")
    found = grid_join(
        a,
        b,
        F.col("x") <= F.col("y"),
        rows=grid[0],
        cols=grid[1],
        left_key=["i"] if keyed else [],
        right_key=["j"] if keyed else [],
        seed=seed,
    )
    expected = [
        (i, x, j, y) for i, x in enumerate(left) for j, y in enumerate(right) if x <= y
    ]
    assert found.columns == ["i", "x", "j", "y"]
    assert rows_of(found) == sorted(expected)


@pytest.mark.parametrize("grid", [(1, 1), (1, 4), (4, 1), (6, 6), (3, 2)])
def test_grid_equals_broadcast(spark, grid):
    left = spark.range(200).select((F.col("id") % 11).alias("x"))
    right = spark.range(30).select((F.col("id") % 13).alias("y"))
    condition = F.col("x") <= F.col("y")
    expected = rows_of(theta_join(left, right, condition))
    for seed in (0, 1):
        found = grid_join(left, right, condition, rows=grid[0], cols=grid[1], seed=seed)
        assert rows_of(found) == expected


def test_theta_join_broadcasts_only_a_measured_small_side(spark):
    small_side = spark.range(10).withColumnRenamed("id", "y")
    large_side = spark.range(100_000).withColumnRenamed("id", "x")
    condition = F.col("x") <= F.col("y")
    right = plan_of(theta_join(large_side, small_side, condition, limit=1000))
    assert "BroadcastNestedLoopJoin BuildRight" in right
    left = plan_of(theta_join(small_side, large_side, condition, limit=1000))
    assert "BroadcastNestedLoopJoin BuildLeft" in left
    grid = plan_of(
        theta_join(large_side, small_side, condition, limit=1, left_key=["x"], right_key=["y"])
    )
    assert "SortMergeJoin [_grid_row" in grid and "Broadcast" not in grid


def test_grid_on_equal_columns(skewed, many_offers):
    plain = rows_of(many_offers[0].join(skewed[0], "offer_id"))
    assert rows_of(grid_join(many_offers[0], skewed[0], on=["offer_id"], rows=2, cols=3)) == plain


def test_placement_is_balanced_and_stable(spark):
    ids = spark.range(6000)
    for cell in (hashed_cell(6, ["id"], 1), random_cell(6, 1)):
        counts = ids.select(cell.alias("c")).groupBy("c").count().collect()
        assert {row["c"] for row in counts} == set(range(6))
        assert all(850 < row["count"] < 1150 for row in counts)
    cell = hashed_cell(6, ["id"], 1).alias("c")
    assert rows_of(ids.select("id", cell)) == rows_of(ids.repartition(7).select("id", cell))
