"""Every registered query against its SQL, on the two smaller data sets."""

import re

import pytest
from compare import assert_same, connect, plan_of
from conftest import TESTDATA
from pyspark.sql import functions as F

import __spark_entry__ as registered
from gradeweave.functions.grades import given_in
from gradeweave.operators.grouping import grade_lists, list_text
from gradeweave.operators.joins import equi_join
from gradeweave.operators.theta import grid_join
from gradeweave.plans.averages import average_of_course, average_of_only_offer, passed
from gradeweave.plans.sqltext import average_by_offer, average_of_student, register_joined
from gradeweave.sources.standins import offers, points, registrations

QUERIES = registered.queries()
ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def data(request):
    folder = f"{TESTDATA}/{request.param}"
    return folder, connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    folder, connection = data
    assert_same(QUERIES[name](spark, folder), connection, ORACLES[name])


def test_every_query_has_sql_unless_random():
    # The corpus queries, where they are installed, have tests of their own.
    own = {name for name in QUERIES if not re.match(r"op[0-9]+_|pipeline$", name)}
    assert own - set(ORACLES) == {"sample_rows"}
    assert set(ORACLES) <= set(QUERIES)


def test_sample_is_a_part_of_the_rows(spark, data):
    folder, connection = data
    total = connection.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    rows = QUERIES["sample_rows"](spark, folder)
    assert 0.2 * total < rows.count() < 0.3 * total
    whole = registered.registrations(spark, folder)
    assert rows.exceptAll(whole).isEmpty()


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert [tuple(row) for row in rows] == [(60, pytest.approx(rows[0]["average_grade"]))]


OTHER_PLANS = {
    "avg_course_double": lambda spark, folder: average_of_course(
        offers(spark, folder), registrations(spark, folder), limit=0, **registered.MULTI
    ),
    "avg_single_offer": lambda spark, folder: average_of_only_offer(
        offers(spark, folder), registrations(spark, folder), limit=0, **registered.SINGLE
    ),
    "avg_single_offer_rejected": lambda spark, folder: average_of_only_offer(
        offers(spark, folder), registrations(spark, folder), limit=0, **registered.MULTI
    ),
    "avg_student": lambda spark, folder: average_of_student(
        spark,
        offers(spark, folder),
        registrations(spark, folder),
        student_id=registered.STUDENT,
        limit=0,
    ),
    "avg_by_offer": lambda spark, folder: average_by_offer(
        spark, offers(spark, folder), registrations(spark, folder), limit=0, **registered.PERIOD
    ),
    "equi_join": lambda spark, folder: equi_join(
        offers(spark, folder),
        registrations(spark, folder),
        "offer_id",
        hot=spark.range(1, 501).selectExpr("id AS offer_id", "2 AS left_parts", "3 AS right_parts"),
    ),
    "collect_grades": lambda spark, folder: grade_lists(
        passed(registrations(spark, folder)), "offer_id", length=100
    ).select("offer_id", "part", list_text().alias("grades")),
    # Every registration meets every point on the grid, without counting grades first.
    "grade_cdf": lambda spark, folder: grid_join(
        registrations(spark, folder), points(spark, folder), F.col("grade") <= F.col("q"),
        rows=4, cols=2,
    )
    .groupBy("q")
    .agg(F.count("*").alias("n")),
}


@pytest.mark.parametrize("name", sorted(OTHER_PLANS))
def test_other_plans_give_the_same_rows(spark, data, name):
    folder, connection = data
    assert_same(OTHER_PLANS[name](spark, folder), connection, ORACLES[name])


def test_filters_and_columns_reach_the_scans(spark):
    folder = f"{TESTDATA}/sf0.001"
    df = QUERIES["avg_course_double"](spark, folder)
    details = plan_of(df, "formatted")
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in details
    chosen = offers(spark, folder).where(given_in(60, 2000, 4)).select("offer_id")
    assert "EqualTo(o_custkey,60)" in plan_of(chosen, "formatted")
    plan = plan_of(df)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan


def test_totals_are_shuffled_before_the_join_not_registrations(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folder = f"{TESTDATA}/sf0.001"
        tables = offers(spark, folder), registrations(spark, folder)
        plan = plan_of(average_by_offer(spark, *tables, limit=0, **registered.PERIOD))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "partial_sum" in plan
    # One shuffle per table, none after the join.
    assert plan.count("Exchange hashpartitioning") == 2
    # With the period broadcast, only its registrations are summed.
    plan = plan_of(QUERIES["avg_by_offer"](spark, folder))
    assert plan.index("partial_sum") < plan.index("BroadcastHashJoin")
    assert plan.count("Exchange hashpartitioning") == 1


def test_registering_the_join_runs_nothing_and_spares_views(spark):
    folder = f"{TESTDATA}/sf0.001"
    spark.range(3).createOrReplaceTempView("registrations")
    spark.sparkContext.setJobGroup("registering", "")
    register_joined(offers(spark, folder), registrations(spark, folder), "co")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("registering")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(jobs)
    average_of_student(spark, offers(spark, folder), registrations(spark, folder), student_id=3)
    assert spark.table("registrations").count() == 3
