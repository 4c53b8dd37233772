import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")

OFFER_SCHEMA = "offer_id int, course_id int, yr int, quartile int"
REGISTRATION_SCHEMA = "offer_id int, student_id int, grade int"

OFFERS = [(1, 10, 2016, 2), (2, 10, 2016, 2), (3, 20, 2016, 2), (4, 20, 2017, 1)]
REGISTRATIONS = [
    (1, 3, 7),
    (1, 3, None),
    (1, 4, 5),
    (1, 4, 5),
    (2, 5, 9),
    (3, 6, 4),
    (4, 3, 10),
    (99, 3, 8),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def offers(spark):
    return spark.createDataFrame(OFFERS, OFFER_SCHEMA)


@pytest.fixture(scope="session")
def registrations(spark):
    return spark.createDataFrame(REGISTRATIONS, REGISTRATION_SCHEMA)
