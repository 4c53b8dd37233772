"""Run one query over a folder of table files; print its rows, or write them.

    python -m gradeweave FOLDER average-of-course --course 1127 --year 2007 --quartile 3
    spark-submit ... gradeweave/__main__.py --output RESULT FOLDER cumulative-counts
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gradeweave.operators.joins import first_joined_row
from gradeweave.plans.averages import (
    average_of_course,
    average_of_only_offer,
    course_report,
    outcome_of_only_offer,
)
from gradeweave.plans.cdf import (
    cumulative_counts,
    cumulative_counts_by_rank,
    cumulative_counts_on_grid,
)
from gradeweave.plans.sqltext import average_by_offer, average_of_student
from gradeweave.sources.tables import read_table


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gradeweave", description=__doc__.splitlines()[0])
    parser.add_argument("folder", help="folder that holds the table files")
    parser.add_argument(
        "--registrations",
        default="CourseRegistrations",
        choices=["CourseRegistrations", "CourseRegistrations2"],
        help="which table holds the registrations",
    )
    parser.add_argument("--wide-keys", action="store_true", help="ids may exceed 32 bits")
    parser.add_argument("--output", help="write all rows as Parquet to this new folder")
    parser.add_argument("--preview", type=int, help="print so many rows at most")
    queries = parser.add_subparsers(dest="query", required=True)
    queries.add_parser("first-row", help="first row of offers joined with registrations")
    by_offer = queries.add_parser("average-by-offer", help="average passing grade per offer")
    of_student = queries.add_parser("average-of-student", help="average of one student")
    of_student.add_argument("--student", type=int, required=True)
    of_course = queries.add_parser("average-of-course", help="average of a course in a period")
    of_course.add_argument("--message", action="store_true", help="as one line of text")
    of_course.add_argument("--single-precision", action="store_true")
    only_offer = queries.add_parser("average-of-only-offer", help="the same, if it is one offer")
    only_offer.add_argument(
        "--outcome", action="store_true", help="one row that also says why there is no average"
    )
    counts = queries.add_parser("cumulative-counts", help="grades at or below each point")
    how = counts.add_mutually_exclusive_group()
    how.add_argument("--grid", action="store_true", help="join on a grid of cells")
    how.add_argument("--rank", action="store_true", help="count by rank, without a join")
    for command in (by_offer, of_course, only_offer):
        command.add_argument("--year", type=int, required=True)
        command.add_argument("--quartile", type=int, required=True)
    for command in (of_course, only_offer):
        command.add_argument("--course", type=int, required=True)
    return parser


def run(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """The rows of the chosen query."""

    def table(name: str) -> DataFrame:
        key_type = LongType() if options.wide_keys else None
        return read_table(spark, options.folder, name, key_type=key_type)

    registrations = table(options.registrations)
    if options.query == "cumulative-counts":
        form = cumulative_counts_on_grid if options.grid else cumulative_counts
        form = cumulative_counts_by_rank if options.rank else form
        return form(registrations, table("QuantilePoints"))

    offers = table("CourseOffers")
    if options.query == "first-row":
        return first_joined_row(offers, registrations, "offer_id")
    if options.query == "average-of-student":
        return average_of_student(spark, offers, registrations, student_id=options.student)
    period = {"year": options.year, "quartile": options.quartile}
    if options.query == "average-by-offer":
        return average_by_offer(spark, offers, registrations, **period)
    if options.query == "average-of-only-offer":
        form = outcome_of_only_offer if options.outcome else average_of_only_offer
        return form(offers, registrations, course_id=options.course, **period)
    if options.message:
        return course_report(offers, registrations, course_id=options.course, **period)
    return average_of_course(
        offers,
        registrations,
        course_id=options.course,
        single_precision=options.single_precision,
        **period,
    )


def main(arguments: Sequence[str] | None = None) -> None:
    options = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("gradeweave").getOrCreate()
    rows = run(spark, options)
    if options.output:
        rows.write.parquet(options.output)
    else:
        print_rows(rows if options.preview is None else rows.limit(options.preview))


def print_rows(rows: DataFrame) -> None:
    """Every row, one line each; they come to the driver one partition at a time."""
    print(f"|{' |'.join(rows.columns)} |")
    for row in rows.toLocalIterator():
        print(f"|{' |'.join('NULL' if cell is None else str(cell) for cell in row)} |")


if __name__ == "__main__":
    main()
