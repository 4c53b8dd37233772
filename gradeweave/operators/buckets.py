"""Tables stored for repeated joins on one key, which then need no shuffle.

Both sides are shuffled once, into equally many buckets of the key, and written sorted. Every
later join or grouping on the key reads the buckets as they are. Rows of hot keys would make one
bucket too large; they are stored apart and joined by ``equi_join``, which cuts them into parts.
"""

from __future__ import annotations

import uuid
from math import ceil
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.operators.joins import equi_join, hot_keys
from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast, measure
from gradeweave.sources.shared import new_path, remove_at_end, written

BUCKET_BYTES = 256 * 1024 * 1024


class Bucketed(NamedTuple):
    """Two sides in buckets of ``key``, with the rows of hot keys apart (None if there are none)."""

    key: str
    left: DataFrame
    right: DataFrame
    hot: DataFrame | None = None
    hot_left: DataFrame | None = None
    hot_right: DataFrame | None = None

    def join(self) -> DataFrame:
        """The inner join of the two sides, as ``equi_join`` gives it: one key column, bag
        semantics, nulls match nothing. The buckets are joined without a shuffle."""
        columns = self.left.columns + [c for c in self.right.columns if c != self.key]
        # The side with few rows per key is put second: a merge join holds one key's rows of it.
        joined = self.right.hint("merge").join(self.left, self.key).select(columns)
        if self.hot is None:
            return joined
        apart = equi_join(self.hot_left, self.hot_right, self.key, hot=self.hot)
        return joined.unionByName(apart)


def bucketed(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    buckets: int | None = None,
    hot: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
) -> Bucketed:
    """Store both sides for joins on ``key``; ``left`` should have few rows per key.

    ``buckets`` follows the measured size of the larger side unless given. Rows of null key
    are left out, for they join with nothing; all others are stored once. Hot keys are those of
    ``hot`` (found by ``hot_keys`` unless given: key, left_parts, right_parts); should they not
    fit a broadcast, none is put apart. The tables are files of the shared folder, which go when
    the session ends, under names of its catalog; a catalog that outlives it keeps the names.
    """
    if buckets is None:
        largest = max(measure(side).bytes for side in (left, right))
        buckets = max(1, ceil(largest / BUCKET_BYTES))
    if hot is None:
        hot = written(hot_keys(key, left, right), "hot-keys")
    left, right = (side.where(F.col(key).isNotNull()) for side in (left, right))
    if hot.isEmpty() or not fits_broadcast(hot, limit):
        return Bucketed(key, _stored(left, key, buckets), _stored(right, key, buckets))
    few = F.broadcast(hot.select(key))
    cool = [side.join(few, key, "left_anti").select(side.columns) for side in (left, right)]
    apart = [
        written(side.join(few, key, "left_semi").select(side.columns), "hot-rows")
        for side in (left, right)
    ]
    return Bucketed(key, *[_stored(side, key, buckets) for side in cool], hot, *apart)


def _stored(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Written with one file per bucket, and read as a table that knows its buckets."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = new_path(spark, "buckets")
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(name)
    )
    remove_at_end(spark, path)
    return spark.table(name)
