"""Cumulative grade counts."""

import pytest
from conftest import REGISTRATIONS

from gradeweave.plans.cdf import (
    cumulative_counts,
    cumulative_counts_by_rank,
    cumulative_counts_on_grid,
    cumulative_counts_reduced,
)

FORMS = [
    cumulative_counts,
    cumulative_counts_reduced,
    cumulative_counts_on_grid,
    cumulative_counts_by_rank,
]


def expected(points):
    grades = [row[2] for row in REGISTRATIONS if row[2] is not None]
    counts = {}
    for q in points:
        for grade in grades:
            if grade <= q:
                counts[q] = counts.get(q, 0) + 1
    return sorted(counts.items())


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize(
    "points",
    [range(1, 11), [9, 4, 4, 4, 12], [1, 2, 3], [0, None, 7]],
    ids=["all", "equal", "below", "null"],
)
def test_counts_in_order_of_the_points(spark, registrations, form, points):
    df = spark.createDataFrame([(q,) for q in points], "q int")
    found = [tuple(row) for row in form(registrations, df).collect()]
    assert found == expected([q for q in points if q is not None])


def test_known_counts(spark, registrations):
    df = spark.createDataFrame([(q,) for q in range(1, 11)], "q int")
    found = [tuple(row) for row in cumulative_counts(registrations, df).collect()]
    assert found == [(4, 1), (5, 3), (6, 3), (7, 4), (8, 5), (9, 6), (10, 7)]


@pytest.mark.parametrize("shape", [(1, 4), (4, 1), (3, 2)])
def test_grid_shapes(spark, registrations, shape):
    df = spark.createDataFrame([(q,) for q in range(1, 11)], "q int")
    for seed in (0, 7):
        found = cumulative_counts_on_grid(
            registrations, df, rows=shape[0], cols=shape[1], seed=seed
        )
        assert [tuple(row) for row in found.collect()] == expected(range(1, 11))
