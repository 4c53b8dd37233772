"""

Offers are the orders, registrations the lineitems, quantile points the part sizes
(``gradeweave.sources.standins``). Every query runs over the whole tables.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The package lies next to this file, wherever the file is loaded from.
sys.path.insert(0, str(Path(__file__).resolve().parent))

from gradeweave.functions.grades import graded
from gradeweave.operators.buckets import Bucketed, bucketed
from gradeweave.operators.grouping import (
    LIST_LENGTH,
    count_rows,
    explode_lists,
    grade_lists,
    list_text,
    sum_count,
    value_lists,
)
from gradeweave.operators.joins import equi_join, first_joined_row
from gradeweave.operators.pruned import pruned_grid_join, within
from gradeweave.operators.ranks import counts_by_rank
from gradeweave.operators.rows import (
    keep_columns,
    preview,
    sample_by_digest,
    sample_of_files,
    sample_rows,
    tagged,
    tagged_union,
)
from gradeweave.plans.averages import (
    average_of_course,
    average_of_only_offer,
    course_totals,
    outcome_of_only_offer,
    passed,
    totals_of_students,
)
from gradeweave.plans.cdf import (
    cumulative_counts,
    cumulative_counts_by_rank,
    cumulative_counts_on_grid,
    cumulative_counts_on_pruned_grid,
    cumulative_counts_reduced,
)
from gradeweave.plans.sqltext import (
    BY_OFFER_IN_VIEW,
    OF_STUDENT_IN_VIEW,
    average_by_offer,
    average_of_student,
    register_joined,
)
from gradeweave.sources.schemas import PASS_MARK, PASSING_GRADES, table_schema
from gradeweave.sources.shared import shared_copy
from gradeweave.sources.standins import offers, point_rows, points, registrations
from gradeweave.sources.tables import (
    append_tag,
    drop_header,
    drop_missing,
    first_line,
    header_lines,
    parse_lines,
    read_lines,
    read_table,
    read_with_header_row,
    table_path,
    to_lines,
    write_table,
)

# The corpus operators and the pipeline over them; everything else works without them.
try:
    import corpus_pipeline
    from gradeweave.llm import queries as corpus
except ImportError:
    # The package or a library it needs is not here.
    corpus = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"

# A course with several offers in the period, and one with a single offer.
MULTI = {"course_id": 60, "year": 2000, "quartile": 4}
SINGLE = {"course_id": 9, "year": 2001, "quartile": 1}
OUTCOMES = {"one": SINGLE, "several": MULTI, "none": {**MULTI, "year": 1900}}
PERIOD = {"year": 1998, "quartile": 2}
NEARBY = 2
STUDENT = 3
NO_STUDENT = -3
STUDENTS = [3, 1, 4, 1, 5, 9, 2, 6]

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Average passing grade of a course in a period, on the smallest tables."""
    return queries()["avg_course_double"](spark, SMOKE_DIR)


# --- tables as text files -------------------------------------------------------------


def _text_copy(spark: SparkSession, sf: str, rows: Query, name: str) -> str:
    """The folder of a table's text copy: one per table and session, shared by its scans."""
    return shared_copy(
        spark, f"{name} of {sf}", lambda folder: write_table(rows(spark, sf), folder, name)
    )


def _scan_table(spark: SparkSession, sf: str) -> DataFrame:
    folder = _text_copy(spark, sf, offers, "CourseOffers")
    return read_table(spark, folder, "CourseOffers", key_type=LongType())


def _scan_points(spark: SparkSession, sf: str) -> DataFrame:
    folder = _text_copy(spark, sf, point_rows, "QuantilePoints")
    return read_table(spark, folder, "QuantilePoints")


def _written_registrations(spark: SparkSession, sf: str) -> str:
    return _text_copy(spark, sf, registrations, "CourseRegistrations")


def _scan_header_as_null(spark: SparkSession, sf: str) -> DataFrame:
    folder = _written_registrations(spark, sf)
    rows = read_with_header_row(
        spark, folder, "CourseRegistrations", key_type=LongType(), flagged=True
    )
    # There is one header line per part file, shown as one.
    return rows.where(~F.col("header")).unionByName(rows.where("header").distinct())


def _header_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = table_path(_written_registrations(spark, sf), "CourseRegistrations")
    first = header_lines(spark, path)
    # How many files there are is Spark's to choose.
    return first.select("value").distinct()


def _drop_header(spark: SparkSession, sf: str) -> DataFrame:
    path = table_path(_written_registrations(spark, sf), "CourseRegistrations")
    return drop_missing(drop_header(read_lines(spark, path), first_line(spark, path)))


def _split_cast(spark: SparkSession, sf: str) -> DataFrame:
    schema = table_schema("CourseRegistrations", LongType())
    return parse_lines(to_lines(registrations(spark, sf)), schema)


def _tag_lines(spark: SparkSession, sf: str) -> DataFrame:
    return append_tag(to_lines(offers(spark, sf)), "CO")


# --- joins and averages ---------------------------------------------------------------


def _avg_course(single_precision: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return average_of_course(
            offers(spark, sf),
            registrations(spark, sf),
            single_precision=single_precision,
            **MULTI,
        )

    return run


def _avg_single_offer(which: dict[str, int]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return average_of_only_offer(offers(spark, sf), registrations(spark, sf), **which)

    return run


def _outcome_of(which: dict[str, int]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return outcome_of_only_offer(offers(spark, sf), registrations(spark, sf), **which)

    return run


def _avg_by_offer(spark: SparkSession, sf: str) -> DataFrame:
    return average_by_offer(spark, offers(spark, sf), registrations(spark, sf), **PERIOD)


def _avg_student(student_id: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return average_of_student(
            spark, offers(spark, sf), registrations(spark, sf), student_id=student_id
        )

    return run


def _over_joined_view(text: str, **values: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        register_joined(offers(spark, sf), registrations(spark, sf), "co")
        return spark.sql(text, args={**values, "pass_mark": PASS_MARK})

    return run


def _format_result(spark: SparkSession, sf: str) -> DataFrame:
    totals = course_totals(offers(spark, sf), registrations(spark, sf), **MULTI)
    # Integers only: engines differ in how they print a float.
    message = F.concat(
        F.lit("CourseId = "),
        F.col("course_id").cast("string"),
        F.lit(", sum = "),
        F.col("s").cast("string"),
        F.lit(", count = "),
        F.col("n").cast("string"),
        F.lit(", and all grades >= 5"),
    )
    return totals.select(message.alias("msg"))


def _local_sum_count(spark: SparkSession, sf: str) -> DataFrame:
    students = pa.table({"student_id": pa.array(STUDENTS, pa.int64())})
    return totals_of_students(registrations(spark, sf), spark.createDataFrame(students))


def _tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    both = tagged_union(
        tagged(offers(spark, sf), "offer_id", "course_id", "CO"),
        tagged(passed(registrations(spark, sf)), "offer_id", "grade", "CR"),
    )
    return both.groupBy("tag").agg(F.count("*").alias("n"), F.sum("v").alias("s"))


def _registrations_nearby(spark: SparkSession, sf: str) -> DataFrame:
    given = registrations(spark, sf).select(F.col("offer_id").alias("registered"), "student_id")
    pairs = pruned_grid_join(
        offers(spark, sf).select("offer_id"),
        given,
        "offer_id",
        "registered",
        within(-NEARBY, NEARBY),
        F.col("offer_id") != F.col("registered"),
        left_key=["offer_id"],
        right_key=["registered", "student_id"],
    )
    return pairs.groupBy("offer_id").agg(
        F.count("*").alias("n"), F.sum("student_id").alias("students")
    )


# The registrations in buckets of their offers, by session: both joins read the same ones.
_buckets: dict[tuple[str, str], Bucketed] = {}


def _bucketed_offers(spark: SparkSession, sf: str) -> Bucketed:
    of = (spark.sparkContext.applicationId, sf)
    if of not in _buckets:
        _buckets[of] = bucketed(offers(spark, sf), registrations(spark, sf), "offer_id")
    return _buckets[of]


def _bucketed_totals(spark: SparkSession, sf: str) -> DataFrame:
    joined = _bucketed_offers(spark, sf).join()
    return joined.groupBy("offer_id", "course_id").agg(
        F.sum("grade").alias("s"), F.count("grade").alias("n")
    )


def _sample_of_files(spark: SparkSession, sf: str) -> DataFrame:
    drawn = sample_of_files(spark, f"{sf}/lineitem.parquet")
    return drawn.select("l_orderkey", "l_linenumber", "l_quantity")


# --- lists ----------------------------------------------------------------------------


def _passed_lists(spark: SparkSession, sf: str) -> DataFrame:
    return grade_lists(passed(registrations(spark, sf)), "offer_id", domain=PASSING_GRADES)


def _collect_grades(spark: SparkSession, sf: str) -> DataFrame:
    return _passed_lists(spark, sf).select("offer_id", "part", list_text().alias("grades"))


def _collect_students(key: str, length: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        other = "student_id" if key == "offer_id" else "offer_id"
        lists = value_lists(registrations(spark, sf), key, other, length=length)
        return lists.select(key, "part", list_text("values").alias(f"{other.split('_')[0]}s"))

    return run


def _explode_grades(spark: SparkSession, sf: str) -> DataFrame:
    return explode_lists(_passed_lists(spark, sf), "offer_id")


def queries() -> dict[str, Query]:
    return {
        "scan_table": _scan_table,
        "scan_points": _scan_points,
        "scan_header_as_null": _scan_header_as_null,
        "header_lines": _header_lines,
        "drop_header": _drop_header,
        "split_cast": _split_cast,
        "tag_lines": _tag_lines,
        "equi_join": lambda spark, sf: equi_join(
            offers(spark, sf), registrations(spark, sf), "offer_id"
        ),
        "bucketed_join": lambda spark, sf: _bucketed_offers(spark, sf).join(),
        "bucketed_totals": _bucketed_totals,
        "join_first_row": lambda spark, sf: first_joined_row(
            offers(spark, sf), registrations(spark, sf), "offer_id"
        ),
        "avg_by_offer": _avg_by_offer,
        "avg_student": _avg_student(STUDENT),
        "avg_student_empty": _avg_student(NO_STUDENT),
        "joined_view_by_offer": _over_joined_view(BY_OFFER_IN_VIEW, **PERIOD),
        "joined_view_student": _over_joined_view(OF_STUDENT_IN_VIEW, student=STUDENT),
        "passed": lambda spark, sf: passed(registrations(spark, sf)),
        "project_cols": lambda spark, sf: keep_columns(registrations(spark, sf), {2, 0}),
        "avg_course_double": _avg_course(False),
        "avg_course_float": _avg_course(True),
        "avg_single_offer": _avg_single_offer(SINGLE),
        "avg_single_offer_rejected": _avg_single_offer(MULTI),
        **{f"outcome_{name}": _outcome_of(which) for name, which in OUTCOMES.items()},
        "sum_count": lambda spark, sf: sum_count(registrations(spark, sf), "student_id"),
        "local_sum_count": _local_sum_count,
        "count_rows": lambda spark, sf: count_rows(passed(registrations(spark, sf))),
        "tagged_union": _tagged_union,
        "collect_grades": _collect_grades,
        "collect_students": _collect_students("offer_id", LIST_LENGTH),
        "collect_students_in_parts": _collect_students("offer_id", 3),
        "collect_offers_in_parts": _collect_students("student_id", 100),
        "explode_grades": _explode_grades,
        "grade_cdf": lambda spark, sf: cumulative_counts(
            registrations(spark, sf), points(spark, sf)
        ),
        "grade_cdf_preagg": lambda spark, sf: cumulative_counts_reduced(
            registrations(spark, sf), point_rows(spark, sf)
        ),
        "grade_cdf_grid": lambda spark, sf: cumulative_counts_on_grid(
            registrations(spark, sf), points(spark, sf)
        ),
        "grade_cdf_pruned": lambda spark, sf: cumulative_counts_on_pruned_grid(
            registrations(spark, sf), point_rows(spark, sf)
        ),
        "registrations_nearby": _registrations_nearby,
        "grade_cdf_rank": lambda spark, sf: cumulative_counts_by_rank(
            registrations(spark, sf), point_rows(spark, sf)
        ),
        "later_offers": lambda spark, sf: counts_by_rank(
            registrations(spark, sf), offers(spark, sf), "offer_id", "offer_id", ">"
        ),
        "preview_rows": lambda spark, sf: preview(registrations(spark, sf).where(graded())),
        "sample_by_digest": lambda spark, sf: sample_by_digest(registrations(spark, sf)),
        "sample_of_files": _sample_of_files,
        "sample_rows": lambda spark, sf: sample_rows(registrations(spark, sf)),
        "format_result": _format_result,
        **_of_corpus(),
    }


def _of_corpus() -> dict[str, Query]:
    if corpus is None:
        return {}
    return {**corpus.QUERIES, "pipeline": corpus_pipeline.run}


def _sql_of_corpus() -> dict[str, str]:
    if corpus is None:
        return {}
    whole = corpus_pipeline.ORACLE_SQL
    return {**corpus.ORACLE_SQL, **({"pipeline": whole} if whole else {})}


# --- the same in SQL ------------------------------------------------------------------

_OFFERS = """(SELECT o_orderkey AS offer_id, o_custkey AS course_id,
  CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(quarter(o_orderdate) AS INTEGER) AS quartile
  FROM orders)"""

_REGISTRATIONS = """(SELECT l_orderkey AS offer_id, l_suppkey AS student_id,
  nullif(CAST(l_quantity AS INTEGER) % 11, 0) AS grade FROM lineitem)"""

_POINT_ROWS = "(SELECT p_size AS q FROM part)"
_POINTS = "(SELECT DISTINCT p_size AS q FROM part)"
_PASSED = f"(SELECT offer_id, grade FROM {_REGISTRATIONS} WHERE grade >= 5)"


def _course_rows(which: dict[str, int]) -> str:
    return (
        f"FROM {_REGISTRATIONS} r JOIN {_OFFERS} o ON r.offer_id = o.offer_id "
        f"WHERE grade >= 5 AND course_id = {which['course_id']} "
        f"AND yr = {which['year']} AND quartile = {which['quartile']}"
    )


def _only_offer(which: dict[str, int]) -> str:
    return f"""
      SELECT max(offer_id) AS offer_id,
        CAST(CAST(sum(s) AS FLOAT) / CAST(sum(n) AS FLOAT) AS FLOAT) AS average_grade
      FROM (
        SELECT offer_id, sum(grade) AS s, count(*) AS n FROM {_PASSED}
        WHERE offer_id IN (SELECT offer_id FROM {_OFFERS}
          WHERE course_id = {which['course_id']} AND yr = {which['year']}
          AND quartile = {which['quartile']})
        GROUP BY offer_id)
      HAVING count(*) = 1"""


def _student_average(student_id: int) -> str:
    return f"""
      SELECT avg(grade) AS average_grade
      FROM {_OFFERS} o JOIN {_REGISTRATIONS} r ON o.offer_id = r.offer_id
      WHERE student_id = {student_id} AND grade >= 5"""


def _cumulative(points_sql: str) -> str:
    return f"""
      SELECT q, count(*) AS n FROM {_REGISTRATIONS} JOIN {points_sql} ON grade <= q GROUP BY q"""


def _averages_by_offer() -> str:
    return f"""
      SELECT r.offer_id, avg(grade) AS average_grade
      FROM {_OFFERS} o JOIN {_REGISTRATIONS} r ON o.offer_id = r.offer_id
      WHERE yr = {PERIOD['year']} AND quartile = {PERIOD['quartile']} AND grade >= 5
      GROUP BY r.offer_id"""


def _lists(key: str, value: str, name: str, length: int) -> str:
    return f"""
      SELECT {key}, part, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY {value}) AS {name}
      FROM (SELECT {key}, {value}, (row_number() OVER (
          PARTITION BY {key} ORDER BY {value}) - 1) // {length} AS part
        FROM {_REGISTRATIONS})
      GROUP BY {key}, part"""


def _outcome(which: dict[str, int]) -> str:
    chosen = (
        f"(SELECT DISTINCT offer_id FROM {_OFFERS} WHERE course_id = {which['course_id']} "
        f"AND yr = {which['year']} AND quartile = {which['quartile']})"
    )
    return f"""
      SELECT CASE WHEN n_graded = 1 THEN 'one' WHEN n_graded > 1 THEN 'several offers'
          WHEN n_offers > 0 THEN 'no passed grade' ELSE 'no offer' END AS outcome,
        n_offers, n_graded,
        CASE WHEN n_graded = 1 THEN offer_id END AS offer_id,
        CASE WHEN n_graded = 1 THEN CAST(CAST(s AS FLOAT) / CAST(n AS FLOAT) AS FLOAT) END
          AS average_grade
      FROM (SELECT count(DISTINCT offer_id) AS n_graded, max(offer_id) AS offer_id,
          sum(grade) AS s, count(*) AS n
        FROM {_PASSED} WHERE offer_id IN {chosen})
      CROSS JOIN (SELECT count(*) AS n_offers FROM {chosen})"""


def oracle_sql() -> dict[str, str]:
    """SQL for every query but ``sample_rows``, whose rows are random."""
    student_list = ", ".join(f"({s})" for s in STUDENTS)
    return {
        "scan_table": f"SELECT * FROM {_OFFERS}",
        "scan_points": f"SELECT * FROM {_POINT_ROWS}",
        "scan_header_as_null": f"""
          SELECT *, false AS header, CAST(NULL AS VARCHAR) AS malformed FROM {_REGISTRATIONS}
          UNION ALL SELECT NULL, NULL, NULL, true, NULL""",
        "header_lines": f"""
          SELECT 'CourseRegistrations ' || CAST(count(*) AS VARCHAR)
            || ':INT CourseOfferId,INT StudentRegistrationId,GRADE Grade' AS value
          FROM {_REGISTRATIONS}""",
        "drop_header": f"""
          SELECT CAST(offer_id AS VARCHAR) || ',' || CAST(student_id AS VARCHAR) || ','
            || CAST(grade AS VARCHAR) AS value
          FROM {_REGISTRATIONS} WHERE grade IS NOT NULL""",
        "split_cast": f"SELECT * FROM {_REGISTRATIONS}",
        "tag_lines": f"""
          SELECT CAST(offer_id AS VARCHAR) || ',' || CAST(course_id AS VARCHAR) || ','
            || CAST(yr AS VARCHAR) || ',' || CAST(quartile AS VARCHAR) || ',CO' AS value
          FROM {_OFFERS}""",
        "equi_join": f"""
          SELECT o.offer_id, course_id, yr, quartile, student_id, grade
          FROM {_OFFERS} o JOIN {_REGISTRATIONS} r ON o.offer_id = r.offer_id""",
        "bucketed_join": f"""
          SELECT o.offer_id, course_id, yr, quartile, student_id, grade
          FROM {_OFFERS} o JOIN {_REGISTRATIONS} r ON o.offer_id = r.offer_id""",
        "bucketed_totals": f"""
          SELECT o.offer_id, course_id, CAST(sum(grade) AS BIGINT) AS s, count(grade) AS n
          FROM {_OFFERS} o JOIN {_REGISTRATIONS} r ON o.offer_id = r.offer_id
          GROUP BY o.offer_id, course_id""",
        "join_first_row": f"""
          SELECT o.offer_id, course_id, yr, quartile, student_id, grade
          FROM {_OFFERS} o JOIN {_REGISTRATIONS} r ON o.offer_id = r.offer_id
          ORDER BY o.offer_id, course_id, yr, quartile, student_id, grade NULLS FIRST
          LIMIT 1""",
        "avg_by_offer": _averages_by_offer(),
        "joined_view_by_offer": _averages_by_offer(),
        "joined_view_student": _student_average(STUDENT),
        "avg_student": _student_average(STUDENT),
        "avg_student_empty": _student_average(NO_STUDENT),
        "passed": f"SELECT * FROM {_PASSED}",
        "project_cols": f"SELECT offer_id, grade FROM {_REGISTRATIONS}",
        "avg_course_double": f"""
          SELECT course_id, CAST(sum(grade) AS DOUBLE) / count(*) AS average_grade
          {_course_rows(MULTI)} GROUP BY course_id""",
        "avg_course_float": f"""
          SELECT course_id, CAST(CAST(sum(grade) AS FLOAT) / CAST(count(*) AS FLOAT) AS FLOAT)
            AS average_grade
          {_course_rows(MULTI)} GROUP BY course_id""",
        "avg_single_offer": _only_offer(SINGLE),
        "avg_single_offer_rejected": _only_offer(MULTI),
        **{f"outcome_{name}": _outcome(which) for name, which in OUTCOMES.items()},
        "sum_count": f"""
          SELECT student_id, CAST(sum(grade) AS BIGINT) AS s, count(grade) AS n
          FROM {_REGISTRATIONS} GROUP BY student_id""",
        "local_sum_count": f"""
          SELECT r.student_id, CAST(sum(grade) AS BIGINT) AS s, count(grade) AS n
          FROM (VALUES {student_list}) AS listed(student_id)
          JOIN {_REGISTRATIONS} r ON r.student_id = listed.student_id GROUP BY r.student_id""",
        "count_rows": f"SELECT count(*) AS n FROM {_PASSED}",
        "tagged_union": f"""
          SELECT tag, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM (
            SELECT course_id AS v, 'CO' AS tag FROM {_OFFERS}
            UNION ALL SELECT grade AS v, 'CR' AS tag FROM {_PASSED})
          GROUP BY tag""",
        "collect_grades": f"""
          SELECT offer_id, part, string_agg(CAST(grade AS VARCHAR), ',' ORDER BY grade) AS grades
          FROM (SELECT offer_id, grade, (row_number() OVER (
              PARTITION BY offer_id ORDER BY grade) - 1) // {LIST_LENGTH} AS part
            FROM {_PASSED})
          GROUP BY offer_id, part""",
        "collect_students": _lists("offer_id", "student_id", "students", LIST_LENGTH),
        "collect_students_in_parts": _lists("offer_id", "student_id", "students", 3),
        "collect_offers_in_parts": _lists("student_id", "offer_id", "offers", 100),
        "explode_grades": f"SELECT * FROM {_PASSED}",
        "grade_cdf": _cumulative(_POINTS),
        "grade_cdf_preagg": _cumulative(_POINT_ROWS),
        "grade_cdf_grid": _cumulative(_POINTS),
        "grade_cdf_pruned": _cumulative(_POINT_ROWS),
        "registrations_nearby": f"""
          SELECT o.offer_id, count(*) AS n, CAST(sum(student_id) AS BIGINT) AS students
          FROM {_OFFERS} o, range(-{NEARBY}, {NEARBY} + 1) steps(step), {_REGISTRATIONS} r
          WHERE r.offer_id = o.offer_id + step AND step <> 0
          GROUP BY o.offer_id""",
        "grade_cdf_rank": _cumulative(_POINT_ROWS),
        "later_offers": f"""
          SELECT offer_id, CAST(total - upto AS BIGINT) AS n
          FROM (SELECT offer_id, sum(c) OVER (ORDER BY offer_id) AS upto, sum(c) OVER () AS total
            FROM (SELECT o.offer_id, count(r.offer_id) AS c
              FROM {_OFFERS} o LEFT JOIN {_REGISTRATIONS} r ON r.offer_id = o.offer_id
              GROUP BY o.offer_id))
          WHERE total > upto""",
        "preview_rows": f"""
          SELECT * FROM {_REGISTRATIONS} WHERE grade IS NOT NULL
          ORDER BY offer_id, student_id, grade LIMIT 20""",
        "sample_by_digest": f"""
          SELECT * FROM {_REGISTRATIONS}
          WHERE left(md5(concat_ws(',', offer_id, student_id,
            coalesce(CAST(grade AS VARCHAR), 'null'))), 7) < '4000000'""",
        "sample_of_files": """
          SELECT l_orderkey, l_linenumber, l_quantity
          FROM (SELECT *, row_number() OVER () - 1 AS row_index FROM lineitem)
          WHERE left(md5(':' || CAST(row_index AS VARCHAR)), 7) < '4000000'""",
        "format_result": f"""
          SELECT 'CourseId = ' || CAST(course_id AS VARCHAR) || ', sum = '
            || CAST(sum(grade) AS VARCHAR) || ', count = ' || CAST(count(*) AS VARCHAR)
            || ', and all grades >= 5' AS msg
          {_course_rows(MULTI)} GROUP BY course_id""",
        **_sql_of_corpus(),
    }
