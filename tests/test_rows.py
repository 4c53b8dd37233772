"""Lists, projections, unions, previews."""

import re
from collections import Counter

import pytest
from compare import plan_of, rows_of
from pyspark.sql import functions as F

from gradeweave.operators.grouping import (
    count_rows,
    explode_lists,
    grade_lists,
    list_text,
    value_lists,
)
from gradeweave.operators.rows import keep_columns, preview, sample_rows, tagged, tagged_union
from gradeweave.plans.averages import passed


def test_lists(registrations):
    lists = grade_lists(passed(registrations), "offer_id")
    assert rows_of(lists.select("offer_id", "part", list_text().alias("t"))) == [
        (1, 0, "5,5,7"),
        (2, 0, "9"),
        (4, 0, "10"),
        (99, 0, "8"),
    ]


@pytest.mark.parametrize("length", [1, 2, 3, 7, 1000])
def test_long_lists_are_whole_in_bounded_parts(spark, length):
    grades = {1: [i % 10 + 1 for i in range(997)], 2: [5], 3: [10] * length, 4: [7] * (length + 1)}
    rows = [(key, grade) for key, values in grades.items() for grade in values]
    df = spark.createDataFrame(rows, "k int, grade int").repartition(4)
    lists = grade_lists(df, "k", length=length)
    found = {}
    for key, part, values in rows_of(lists):
        assert 1 <= len(values) <= length
        assert part == len(found.setdefault(key, [])) // length
        found[key] += values
    assert found == {key: sorted(values) for key, values in grades.items()}
    assert Counter(rows_of(explode_lists(lists, "k"))) == Counter(rows)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_lists_of_any_value_are_whole_in_parts(spark, limit):
    values = {1: [f"v{i % 700}" for i in range(997)], None: ["a", "b"] * 3, 3: ["x"] * 250}
    rows = [(key, value) for key, several in values.items() for value in several]
    df = spark.createDataFrame([*rows, (4, None), (1, None)], "k int, v string").repartition(4)
    found = {}
    for key, part, some in value_lists(df, "k", "v", length=100, limit=limit).collect():
        assert some == sorted(some) and len(some) < 400
        found.setdefault(key, {})[part] = some
    assert {key: len(parts) for key, parts in found.items()}[None] == 1
    assert len(found[1]) == 10
    whole = {key: sorted(sum(parts.values(), [])) for key, parts in found.items()}
    assert whole == {key: sorted(several) for key, several in values.items()}


def test_parts_of_a_long_list_are_spread_over_tasks(spark):
    df = spark.range(40_000).select(
        F.expr("id div 40000").alias("k"), (F.col("id") % 10 + 1).cast("int").alias("grade")
    )
    lists = grade_lists(df, "k", length=1000)
    spread = r"hashpartitioning\(k#\d+L, part#\d+L, \d+\), REPARTITION_BY_COL"
    assert re.search(spread, plan_of(lists))
    assert lists.count() == 40
    assert explode_lists(lists, "k").count() == 40_000


def test_short_and_long_lists_share_one_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 300).alias("k"), (F.col("id") % 10 + 1).cast("int").alias("grade")
    )
    lists = grade_lists(df, "k", length=3)
    rows = lists.collect()
    assert {len(row["grades"]) for row in rows} == {1, 3}
    final = plan_of(lists).split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1


@pytest.mark.parametrize("value", [None, 0, 11])
def test_lists_refuse_what_is_no_grade(spark, value):
    df = spark.createDataFrame([(1, 5), (2, value)], "k int, grade int")
    with pytest.raises(Exception, match="value is no grade, k 2"):
        grade_lists(df, "k").collect()


def test_kept_columns_stay_in_table_order(registrations):
    assert keep_columns(registrations, [2, 0]).columns == ["offer_id", "grade"]


def test_tagged_union_keeps_equal_rows(offers, registrations):
    left = tagged(offers, "offer_id", "course_id", "CO")
    right = tagged(passed(registrations), "offer_id", "grade", "CR")
    both = tagged_union(left, right)
    assert both.columns == ["k", "v", "tag"]
    assert Counter(rows_of(both)) == Counter(rows_of(left) + rows_of(right))


def test_preview_is_ordered_and_may_be_short(spark, registrations):
    numbers = spark.range(100).orderBy(F.col("id").desc())
    assert [row["id"] for row in preview(numbers).collect()] == list(range(20))
    short = [tuple(row) for row in preview(registrations).collect()]
    assert len(short) == 8
    assert short[0] == (1, 3, None)


def test_count_rows(registrations):
    assert count_rows(registrations).first()["n"] == 8
    assert count_rows(registrations.limit(0)).first()["n"] == 0


def test_sample_is_repeatable(spark):
    numbers = spark.range(10_000)
    first = rows_of(sample_rows(numbers))
    assert first == rows_of(sample_rows(numbers))
    assert 2200 < len(first) < 2800 and len(set(first)) == len(first)
