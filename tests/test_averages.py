"""Averages on small inputs worked out by hand, under both plans where there are two."""

import numpy as np
import pytest
from compare import rows_of
from conftest import OFFERS, OFFER_SCHEMA, REGISTRATION_SCHEMA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeweave.functions.grades import average_float
from gradeweave.operators.grouping import sum_count
from gradeweave.operators.sizes import BROADCAST_BYTES
from gradeweave.plans.averages import (
    average_of_course,
    average_of_only_offer,
    course_report,
    course_totals,
    passed,
    totals_of_students,
)
from gradeweave.plans.sqltext import average_by_offer, average_of_student, register_joined

# The broadcast plan, and the plan for sides that are too large to broadcast.
LIMITS = [BROADCAST_BYTES, 0]

# Published averages. course, quartile, year, sum, count, float text, double.
GOLDEN = [
    (1127, 3, 2007, 732, 115, "6.365217", 6.3652173913043478),
    (23246, 4, 2017, 403, 72, "5.5972223", 5.5972222222222222),
    (12457, 2, 2014, 233, 33, "7.060606", 7.0606060606060606),
    (31814, 4, 2015, 726, 113, "6.424779", 6.4247787610619469),
]


def golden_inputs(spark, course, quartile, year, total, count):
    """One offer with ``count`` grades of 5 to 10 that sum to ``total``, among other rows."""
    grades = [5] * count
    for i in range(total - 5 * count):
        grades[i % count] += 1
    assert sum(grades) == total and max(grades) <= 10
    offers = [
        (1, course, year, quartile),
        (2, course, year + 1, quartile),
        (3, course + 1, year, quartile),
        (4, course, year, quartile % 4 + 1),
    ]
    rows = [(1, i, grade) for i, grade in enumerate(grades)]
    rows += [(1, 900, 4), (1, 901, None), (2, 1, 10), (3, 1, 10), (4, 1, 10), (5, 1, 10)]
    return (
        spark.createDataFrame(offers, OFFER_SCHEMA),
        spark.createDataFrame(rows, REGISTRATION_SCHEMA),
    )


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("case", GOLDEN, ids=[str(case[0]) for case in GOLDEN])
def test_published_averages(spark, case, limit):
    course, quartile, year, total, count, text, double = case
    offers, registrations = golden_inputs(spark, course, quartile, year, total, count)
    which = {"course_id": course, "year": year, "quartile": quartile}

    assert rows_of(average_of_course(offers, registrations, limit=limit, **which)) == [
        (course, double)
    ]
    single = average_of_course(
        offers, registrations, single_precision=True, limit=limit, **which
    ).select(F.col("average_grade").cast("string"))
    assert rows_of(single) == [(text,)]
    only = average_of_only_offer(offers, registrations, limit=limit, **which)
    assert rows_of(only) == [(1, float(np.float32(text)))]
    assert course_report(offers, registrations, **which).first()["msg"] == (
        f"Average grade (Spark): {text}, for CourseId = {course}, Quartile = {quartile}, "
        f"Year = {year}, and all grades >= 5"
    )


@pytest.mark.parametrize("limit", LIMITS)
def test_course_with_several_offers(offers, registrations, limit):
    which = {"course_id": 10, "year": 2016, "quartile": 2}
    assert rows_of(course_totals(offers, registrations, limit=limit, **which)) == [(10, 26, 4)]
    assert rows_of(average_of_course(offers, registrations, limit=limit, **which)) == [(10, 6.5)]
    assert rows_of(average_of_only_offer(offers, registrations, limit=limit, **which)) == []


@pytest.mark.parametrize("limit", LIMITS)
def test_course_with_one_offer(offers, registrations, limit):
    which = {"course_id": 20, "year": 2017, "quartile": 1}
    assert rows_of(average_of_only_offer(offers, registrations, limit=limit, **which)) == [
        (4, 10.0)
    ]


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize(
    "which",
    [
        {"course_id": 20, "year": 2016, "quartile": 2},  # only a failed grade
        {"course_id": 77, "year": 2016, "quartile": 2},  # no such course
    ],
)
def test_course_without_passed_grades(offers, registrations, which, limit):
    assert rows_of(average_of_course(offers, registrations, limit=limit, **which)) == []
    assert rows_of(average_of_only_offer(offers, registrations, limit=limit, **which)) == []


@pytest.mark.parametrize("limit", LIMITS)
def test_guard_counts_offers_that_still_have_a_passed_grade(spark, registrations, limit):
    offers = spark.createDataFrame(OFFERS + [(5, 20, 2017, 1)], OFFER_SCHEMA)
    which = {"course_id": 20, "year": 2017, "quartile": 1}
    assert rows_of(average_of_only_offer(offers, registrations, limit=limit, **which)) == [
        (4, 10.0)
    ]


@pytest.mark.parametrize("limit", LIMITS)
def test_repeated_offer_counts_twice_in_the_join_but_not_in_the_semi_join(
    spark, registrations, limit
):
    offers = spark.createDataFrame([OFFERS[0], *OFFERS], OFFER_SCHEMA)
    which = {"course_id": 10, "year": 2016, "quartile": 2}
    # Offer 1 twice: 2 * (7 + 5 + 5) + 9 over 7 rows.
    assert rows_of(course_totals(offers, registrations, limit=limit, **which)) == [(10, 43, 7)]
    single = spark.createDataFrame([OFFERS[0], OFFERS[0]], OFFER_SCHEMA)
    assert rows_of(average_of_only_offer(single, registrations, limit=limit, **which)) == [
        (1, float(np.float32(17) / np.float32(3)))
    ]


def test_average_by_offer(spark, offers, registrations):
    assert rows_of(average_by_offer(spark, offers, registrations, year=2016, quartile=2)) == [
        (1, 17 / 3),
        (2, 9.0),
    ]


def test_average_by_offer_with_a_repeated_offer(spark, offers, registrations):
    twice = offers.union(offers)
    assert rows_of(average_by_offer(spark, twice, registrations, year=2016, quartile=2)) == [
        (1, 17 / 3),
        (2, 9.0),
    ]


@pytest.mark.parametrize("limit", LIMITS)
def test_average_of_student(spark, offers, registrations, limit):
    average = average_of_student(spark, offers, registrations, student_id=3, limit=limit)
    assert rows_of(average) == [(8.5,)]
    nobody = average_of_student(spark, offers, registrations, student_id=77, limit=limit)
    assert rows_of(nobody) == [(None,)]


@pytest.mark.parametrize("limit", LIMITS)
def test_average_of_student_weighs_repeated_offers(spark, registrations, limit):
    offers = spark.createDataFrame([OFFERS[0], *OFFERS], OFFER_SCHEMA)
    average = average_of_student(spark, offers, registrations, student_id=3, limit=limit)
    assert rows_of(average) == [((7 + 7 + 10) / 3,)]


def test_own_sql_over_the_registered_join(spark, offers, registrations):
    joined = register_joined(offers, registrations)
    assert joined.count() == joined.where("listed_id = offer_id").count() == 7
    by_offer = spark.sql(
        "SELECT offer_id, AVG(grade) AS average_grade FROM co "
        "WHERE yr = 2016 AND quartile = 2 AND grade >= 5 GROUP BY offer_id"
    )
    assert rows_of(by_offer) == rows_of(
        average_by_offer(spark, offers, registrations, year=2016, quartile=2)
    )
    of_student = spark.sql("SELECT AVG(grade) FROM co WHERE student_id = 3 AND grade >= 5")
    assert rows_of(of_student) == [(8.5,)]


def test_sum_and_count_of_a_local_list(spark):
    grades = [7, 6, 8, 9, 6, 8, 5, 6, 9]
    total = count = 0
    for grade in grades:
        total += grade
        count += 1
    rows = spark.createDataFrame([(1, grade) for grade in grades], "k int, grade int")
    found = sum_count(rows, "k")
    assert rows_of(found) == [(1, total, count)] == [(1, 64, 9)]
    average = found.select(average_float(F.col("s"), F.col("n")).alias("a")).first()["a"]
    assert average == np.float32(64) / np.float32(9)


def test_float_average_rounds_sum_and_count_first(spark):
    row = spark.createDataFrame([(16_777_217, 1)], "s bigint, n bigint")
    assert row.select(average_float(F.col("s"), F.col("n")).alias("a")).first()["a"] == 16_777_216


def test_totals_of_listed_students(spark, registrations):
    students = spark.createDataFrame([(3,), (4,), (3,), (8,)], "student_id int")
    assert rows_of(totals_of_students(registrations, students)) == [(3, 50, 6), (4, 10, 2)]


def test_passed(registrations):
    assert rows_of(passed(registrations)) == [
        (1, 5), (1, 5), (1, 7), (2, 9), (4, 10), (99, 8)
    ]


offer_rows = st.lists(
    st.tuples(st.integers(1, 4), st.integers(1, 2), st.integers(2016, 2017), st.integers(1, 2)),
    max_size=8,
)
registration_rows = st.lists(
    st.tuples(st.integers(1, 5), st.integers(1, 3), st.none() | st.integers(1, 10)), max_size=20
)


@settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(offer_rows, registration_rows)
def test_averages_against_loops(spark, offer_list, registration_list):
    offers = spark.createDataFrame(offer_list, OFFER_SCHEMA)
    registrations = spark.createDataFrame(registration_list, REGISTRATION_SCHEMA)
    which = {"course_id": 1, "year": 2016, "quartile": 2}
    chosen = [row[0] for row in offer_list if row[1:] == (1, 2016, 2)]
    graded = [row for row in registration_list if row[2] is not None and row[2] >= 5]

    grades = [row[2] for offer in chosen for row in graded if row[0] == offer]
    totals = [(1, sum(grades), len(grades))] if grades else []
    left = {row[0] for row in graded if row[0] in chosen}
    own = [row[2] for row in graded if row[0] in left]
    only = []
    if len(left) == 1:
        only = [(max(left), float(np.float32(sum(own)) / np.float32(len(own))))]
    of_student = [row for row in graded if row[1] == 3]
    mine = [row[2] for offer in offer_list for row in of_student if row[0] == offer[0]]
    average = [(sum(mine) / len(mine) if mine else None,)]

    for limit in LIMITS:
        assert rows_of(course_totals(offers, registrations, limit=limit, **which)) == totals
        assert rows_of(average_of_only_offer(offers, registrations, limit=limit, **which)) == only
        student = average_of_student(spark, offers, registrations, student_id=3, limit=limit)
        assert rows_of(student) == average
