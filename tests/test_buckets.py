"""Tables stored for repeated joins, and draws by a row's place in its file."""

import hashlib

import pytest
from compare import plan_of, rows_of

from gradeweave.operators.buckets import bucketed
from gradeweave.operators.joins import equi_join
from gradeweave.operators.rows import sample_of_files


def test_join_and_grouping_without_shuffle(spark, offers, registrations):
    stored = bucketed(offers, registrations, "offer_id", buckets=4)
    joined = stored.join()
    assert rows_of(joined) == rows_of(equi_join(offers, registrations, "offer_id"))
    assert "Exchange" not in plan_of(joined)
    assert "Exchange" not in plan_of(joined.groupBy("offer_id").count())
    # Hardly any rows: one bucket unless asked for more.
    assert bucketed(offers, registrations, "offer_id").join().rdd.getNumPartitions() == 1


def test_hot_keys_are_stored_apart(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, x string")
    right = spark.createDataFrame(
        [(1, i) for i in range(50)] + [(2, 7), (2, 7), (3, 1), (None, 0)], "k int, y int"
    )
    hot = spark.createDataFrame([(1, 1, 4)], "k int, left_parts int, right_parts int")
    stored = bucketed(left, right, "k", buckets=3, hot=hot)
    assert rows_of(stored.right) == [(2, 7), (2, 7), (3, 1)]
    assert stored.hot_right.count() == 50
    assert rows_of(stored.join()) == rows_of(equi_join(left, right, "k"))
    unbounded = bucketed(left, right, "k", buckets=3, hot=hot, limit=0)
    assert unbounded.hot is None
    assert rows_of(unbounded.join()) == rows_of(stored.join())


def test_empty_tables(spark, offers, registrations):
    for left, right in ((offers.limit(0), registrations), (offers, registrations.limit(0))):
        assert bucketed(left, right, "offer_id").join().count() == 0


def drawn(file, index, share):
    return int(hashlib.md5(f"{file}:{index}".encode()).hexdigest()[:7], 16) < share * (1 << 28)


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_sample_of_files(spark, tmp_path, share):
    folder = str(tmp_path / "table")
    # Equal rows, in several files.
    spark.range(900).selectExpr("5 AS x").repartition(3).write.parquet(folder)
    files = spark.read.parquet(folder).selectExpr("_metadata.file_name AS f").groupBy("f").count()
    expected = sum(
        drawn(row["f"], i, share) for row in files.collect() for i in range(row["count"])
    )
    assert sample_of_files(spark, folder, share).count() == expected
    if share == 0.3:
        assert 0 < expected < 900
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        try:
            assert sample_of_files(spark, folder + "/", share).count() == expected
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sample_of_one_file(spark, tmp_path):
    spark.range(200).coalesce(1).write.parquet(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("part-*")
    found = sample_of_files(spark, str(file), 0.5)
    assert [row["id"] for row in found.collect()] == [i for i in range(200) if drawn("", i, 0.5)]
