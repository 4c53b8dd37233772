"""Average passing grades of courses and offers, with the DataFrame API.

All take offers (offer_id, course_id, yr, quartile) and registrations (offer_id, student_id,
grade). The chosen offers are written out first, so that the offers are read once. Then two
plans give the same rows, and the measured size of the chosen offers decides:

* few offers: they are broadcast and the registrations are read once, without a shuffle of
  single registrations;
* many: registrations are first summed per offer, so that the join moves one row per offer
  and no offer, however popular, is heavier than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.grades import (
    average_double,
    average_float,
    average_message,
    given_in,
    passing,
)
from gradeweave.operators.grouping import sum_count
from gradeweave.operators.joins import semi_join
from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast
from gradeweave.sources.shared import written


def passed(registrations: DataFrame) -> DataFrame:
    """offer_id, grade of the registrations that passed."""
    return registrations.where(passing()).select("offer_id", "grade")


def course_totals(
    offers: DataFrame,
    registrations: DataFrame,
    *,
    course_id: int,
    year: int,
    quartile: int,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """course_id, s, n over the passed registrations of all its offers in the period.

    A registration counts once per offer row it matches. No match gives no row.
    """
    chosen = written(
        offers.where(given_in(course_id, year, quartile)).select("offer_id", "course_id"),
        "chosen-offers",
    )
    if fits_broadcast(chosen, limit):
        matched = passed(registrations).join(F.broadcast(chosen), "offer_id")
        return sum_count(matched, "course_id")
    weights = chosen.groupBy("offer_id", "course_id").agg(F.count("*").alias("times"))
    totals = sum_count(passed(registrations), "offer_id")
    return (
        totals.join(weights, "offer_id")
        .groupBy("course_id")
        .agg(
            F.sum(F.col("s") * F.col("times")).alias("s"),
            F.sum(F.col("n") * F.col("times")).alias("n"),
        )
    )


def average_of_course(
    offers: DataFrame,
    registrations: DataFrame,
    *,
    course_id: int,
    year: int,
    quartile: int,
    single_precision: bool = False,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """course_id, average_grade as a double, or as a float in ``single_precision``."""
    totals = course_totals(
        offers, registrations, course_id=course_id, year=year, quartile=quartile, limit=limit
    )
    average = average_float if single_precision else average_double
    return totals.select("course_id", average(F.col("s"), F.col("n")).alias("average_grade"))


def average_of_only_offer(
    offers: DataFrame,
    registrations: DataFrame,
    *,
    course_id: int,
    year: int,
    quartile: int,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """offer_id, average_grade (float) if exactly one matching offer has a passed grade.

    With none or several such offers there is no row; ``outcome_of_only_offer`` says which. A
    registration counts once, also when its offer is listed repeatedly.
    """
    outcome = outcome_of_only_offer(
        offers, registrations, course_id=course_id, year=year, quartile=quartile, limit=limit
    )
    return outcome.where(F.col("outcome") == ONE).select("offer_id", "average_grade")


# What the search for the only offer can come to.
ONE, NO_OFFER, UNGRADED, SEVERAL = "one", "no offer", "no passed grade", "several offers"


def outcome_of_only_offer(
    offers: DataFrame,
    registrations: DataFrame,
    *,
    course_id: int,
    year: int,
    quartile: int,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row: outcome, n_offers, n_graded, offer_id, average_grade (float).

    ``n_offers`` counts the course's offers in the period, each once; ``n_graded`` those with a
    passed grade. The outcome is ``one`` if just one has; else it says why there is no average:
    ``no offer``, ``no passed grade`` or ``several offers``, and offer_id and average_grade are
    null. The counts come out of the job that computes the average. A registration counts once,
    also when its offer is listed repeatedly.
    """
    chosen = written(
        offers.where(given_in(course_id, year, quartile)).select("offer_id"), "chosen-offers"
    )
    if fits_broadcast(chosen, limit):
        matched = passed(registrations).join(F.broadcast(chosen), "offer_id", "left_semi")
        per_offer = sum_count(matched, "offer_id")
    else:
        per_offer = sum_count(passed(registrations), "offer_id").join(
            chosen.distinct(), "offer_id", "left_semi"
        )
    counted = per_offer.agg(
        F.max("offer_id").alias("offer_id"),
        F.sum("s").alias("s"),
        F.sum("n").alias("n"),
        F.count("*").alias("n_graded"),
    )
    listed = chosen.agg(F.countDistinct("offer_id")).scalar().alias("n_offers")
    outcome = (
        F.when(F.col("n_graded") == 1, ONE)
        .when(F.col("n_graded") > 1, SEVERAL)
        .when(F.col("n_offers") > 0, UNGRADED)
        .otherwise(NO_OFFER)
    )
    only = F.col("outcome") == ONE
    return (
        counted.select("*", listed)
        .withColumn("outcome", outcome)
        .select(
            "outcome",
            "n_offers",
            "n_graded",
            F.when(only, F.col("offer_id")).alias("offer_id"),
            F.when(only, average_float(F.col("s"), F.col("n"))).alias("average_grade"),
        )
    )


def course_report(
    offers: DataFrame, registrations: DataFrame, *, course_id: int, year: int, quartile: int
) -> DataFrame:
    """msg: the float average of a course as a printable line."""
    averages = average_of_course(
        offers,
        registrations,
        course_id=course_id,
        year=year,
        quartile=quartile,
        single_precision=True,
    )
    message = average_message(
        F.col("average_grade"), F.col("course_id"), F.lit(year), F.lit(quartile)
    )
    return averages.select(message.alias("msg"))


def totals_of_students(registrations: DataFrame, students: DataFrame) -> DataFrame:
    """student_id, s, n of all grades of the listed students; repeated entries count again.

    ``students`` may be a local list made a DataFrame. Registrations of other students are
    dropped before the sums are shuffled.
    """
    times = students.groupBy("student_id").agg(F.count("*").alias("times"))
    return (
        sum_count(semi_join(registrations, students, "student_id"), "student_id")
        .join(times, "student_id")
        .select(
            "student_id",
            (F.col("s") * F.col("times")).alias("s"),
            (F.col("n") * F.col("times")).alias("n"),
        )
    )
