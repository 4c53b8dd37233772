"""The shared folder."""

import os
import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from compare import rows_of

from gradeweave.operators.buckets import bucketed
from gradeweave.sources.shared import (
    new_path,
    remove_written,
    shared_copy,
    shared_folder,
    written,
)


@pytest.fixture(autouse=True, scope="module")
def nothing_written_before(spark):
    """Other modules' tables are not counted here."""
    remove_written(spark)


def session(**settings):
    return SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None), conf=SimpleNamespace(get=settings.get))


def test_the_named_folder_is_used():
    named = session(**{"spark.checkpoint.dir": "hdfs://a/b/", "spark.master": "yarn"})
    assert shared_folder(named) == "hdfs://a/b"
    first, second = new_path(named, "x"), new_path(named, "x")
    assert first != second and first.startswith("hdfs://a/b/x-")


def test_a_cluster_must_name_a_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(**{"spark.master": "spark://host:7077"}))


def test_a_local_session_may_leave_it_unset():
    local = session(**{"spark.master": "local[4]"})
    assert os.path.isdir(shared_folder(local))
    assert shared_folder(local) == shared_folder(local)


def test_written_rows_and_schema(registrations):
    copy = written(registrations, "copy")
    assert copy.dtypes == registrations.dtypes
    assert rows_of(copy) == rows_of(registrations)
    empty = written(registrations.limit(0), "copy")
    assert empty.dtypes == registrations.dtypes and empty.isEmpty()


def test_a_copy_is_written_once_per_name_and_session(spark, registrations):
    writes = []

    def write(folder):
        writes.append(folder)
        registrations.write.parquet(folder)

    first, again = (shared_copy(spark, "registrations", write) for _ in range(2))
    assert first == again and writes == [first]
    assert shared_copy(spark, "the same, elsewhere", write) != first
    assert rows_of(spark.read.parquet(first)) == rows_of(registrations)


def test_a_copy_that_failed_is_tried_again(spark, registrations):
    def fail(folder):
        registrations.limit(1).write.parquet(folder)
        raise ValueError("half way")

    with pytest.raises(ValueError, match="half way"):
        shared_copy(spark, "fails at first", fail)
    folder = shared_copy(spark, "fails at first", registrations.write.parquet)
    assert rows_of(spark.read.parquet(folder)) == rows_of(registrations)


def test_what_was_written_can_be_removed_and_written_anew(spark, offers, registrations):
    copy = written(registrations, "copy")
    stored = bucketed(offers, registrations, "offer_id", buckets=2)
    folder = shared_copy(spark, "to be removed", registrations.write.parquet)
    paths = remove_written(spark)
    assert folder in paths and any("/copy-" in p for p in paths)
    assert sum("/buckets-" in p for p in paths) == 2 and stored.key == "offer_id"
    assert not any(os.path.exists(p) for p in paths)
    assert remove_written(spark) == []
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist"):
        copy.collect()
    anew = shared_copy(spark, "to be removed", registrations.write.parquet)
    assert anew != folder and rows_of(spark.read.parquet(anew)) == rows_of(registrations)


SESSION = """
import sys
from pyspark.sql import SparkSession
from gradeweave.operators.buckets import bucketed
from gradeweave.sources.shared import shared_copy, written
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1])
         .config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").getOrCreate())
rows = written(spark.range(10), "ten")
shared_copy(spark, "ten", spark.range(10).write.parquet)
print("rows", bucketed(rows, rows, "id", buckets=2).join().count())
{end}
"""


@pytest.mark.parametrize("end", ["", "spark.stop()"])
def test_the_shared_folder_is_empty_after_the_session(tmp_path, end):
    done = subprocess.run(
        [sys.executable, "-c", SESSION.replace("{end}", end), str(tmp_path)],
        cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300,
    )
    assert "rows 10" in done.stdout, done.stderr
    # The JVM removes the files while it ends, shortly after the program has.
    for _ in range(300):
        left = [p for p in tmp_path.rglob("*") if p.is_file()]
        if not left:
            break
        time.sleep(0.1)
    assert left == []
