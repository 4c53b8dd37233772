"""The queries that are SQL text over registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast
from gradeweave.sources.schemas import PASS_MARK
from gradeweave.sources.shared import written

# Over the view of ``register_joined``.
BY_OFFER_IN_VIEW = """
SELECT offer_id, AVG(grade) AS average_grade
FROM co
WHERE yr = :year AND quartile = :quartile AND grade >= :pass_mark
GROUP BY offer_id
"""

OF_STUDENT_IN_VIEW = """
SELECT AVG(grade) AS average_grade FROM co WHERE student_id = :student AND grade >= :pass_mark
"""

# {braces} stand for DataFrames, so no view of the session is touched.
PERIOD_OFFERS = """
SELECT DISTINCT offer_id AS listed_id FROM {offers} WHERE yr = :year AND quartile = :quartile
"""

# Registrations are summed per offer before they meet other offers, so neither an offer with
# very many registrations nor one listed repeatedly weighs on the join.
BY_OFFER = """
SELECT offer_id, CAST(s AS DOUBLE) / n AS average_grade
FROM (
  SELECT offer_id, sum(grade) AS s, count(grade) AS n
  FROM {registrations}
  WHERE grade >= :pass_mark
  GROUP BY offer_id
)
JOIN {period} ON listed_id = offer_id
"""

# The same for a period that is broadcast: other offers' registrations are not even summed.
BY_OFFER_OF_FEW = """
SELECT offer_id, CAST(sum(grade) AS DOUBLE) / count(grade) AS average_grade
FROM {registrations} LEFT SEMI JOIN {period} ON listed_id = offer_id
WHERE grade >= :pass_mark
GROUP BY offer_id
"""

STUDENT_TOTALS = """
SELECT offer_id, sum(grade) AS s, count(grade) AS n
FROM {registrations}
WHERE student_id = :student AND grade >= :pass_mark
GROUP BY offer_id
"""

OF_STUDENT = """
SELECT CAST(sum(s * times) AS DOUBLE) / sum(n * times) AS average_grade
FROM {totals} JOIN {times} ON listed_id = offer_id
"""


def register_joined(offers: DataFrame, registrations: DataFrame, view: str = "co") -> DataFrame:
    """Register offers joined with registrations as a view for the caller's own SQL.

    The key keeps both names: ``listed_id`` from the offers, ``offer_id`` from the
    registrations. Nothing runs before the SQL does; its filters reach both tables, and
    adaptive execution splits what is still skewed then.
    """
    listed = offers.withColumnRenamed("offer_id", "listed_id")
    joined = listed.join(registrations, F.col("listed_id") == F.col("offer_id"))
    joined.createOrReplaceTempView(view)
    return joined


def average_by_offer(
    spark: SparkSession,
    offers: DataFrame,
    registrations: DataFrame,
    *,
    year: int,
    quartile: int,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """offer_id, average_grade (double) of each offer in a period with a passed grade.

    The period's offers are written out and measured. If they are small, they are broadcast
    and pick registrations before these are summed.
    """
    period = written(
        spark.sql(PERIOD_OFFERS, args={"year": year, "quartile": quartile}, offers=offers),
        "period-offers",
    )
    text = BY_OFFER
    if fits_broadcast(period, limit):
        text, period = BY_OFFER_OF_FEW, F.broadcast(period)
    return spark.sql(
        text, args={"pass_mark": PASS_MARK}, registrations=registrations, period=period
    )


def average_of_student(
    spark: SparkSession,
    offers: DataFrame,
    registrations: DataFrame,
    *,
    student_id: int,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """average_grade (double) of a student's passed registrations that have an offer.

    Always one row; null when there is no such registration. The student's sums per offer
    are written out, so that the registrations are read once and the size of the sums is
    known: when they are small they are broadcast and the offers are not shuffled.
    """
    totals = written(
        spark.sql(
            STUDENT_TOTALS,
            args={"student": student_id, "pass_mark": PASS_MARK},
            registrations=registrations,
        ),
        "student-totals",
    )
    listed = offers.select(F.col("offer_id").alias("listed_id"))
    if fits_broadcast(totals, limit):
        totals = F.broadcast(totals)
        times = listed.withColumn("times", F.lit(1))
    else:
        times = listed.groupBy("listed_id").agg(F.count("*").alias("times"))
    return spark.sql(OF_STUDENT, totals=totals, times=times)
