"""Predicates, averages and messages over grades, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeweave.sources.schemas import PASS_MARK


def graded(grade: str = "grade") -> Column:
    """The registration has a grade."""
    return F.col(grade).isNotNull()


def passing(grade: str = "grade") -> Column:
    """The registration has a grade at or above the pass mark."""
    return graded(grade) & (F.col(grade) >= PASS_MARK)


def given_in(course_id: int, year: int, quartile: int) -> Column:
    """The offer is of this course in this period."""
    return (
        (F.col("course_id") == course_id)
        & (F.col("yr") == year)
        & (F.col("quartile") == quartile)
    )


def average_double(total: Column, count: Column) -> Column:
    """64-bit average of an exact integer sum."""
    return total.cast("double") / count.cast("double")


def average_float(total: Column, count: Column) -> Column:
    """32-bit average: sum and count are rounded to float before they are divided."""
    return (total.cast("float") / count.cast("float")).cast("float")


def average_message(average: Column, course_id: Column, year: Column, quartile: Column) -> Column:
    """One printable line with an average and the parameters it belongs to."""
    # The wording of the result line.
    return F.concat(
        F.lit("Average grade (Spark): "),
        average.cast("string"),
        F.lit(", for CourseId = "),
        course_id.cast("string"),
        F.lit(", Quartile = "),
        quartile.cast("string"),
        F.lit(", Year = "),
        year.cast("string"),
        F.lit(f", and all grades >= {PASS_MARK}"),
    )
