"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.operators.sizes import BROADCAST_BYTES, fits_broadcast
from gradeweave.sources.shared import written

# A key is hot when it has more rows than one task should join. Below that, the skew
# handling of adaptive execution is enough.
HOT_ROWS = 5_000_000

# Share of the rows that is looked at to find hot keys: 5000 rows of a key at the bar.
LOOK_AT = 1 / 1000

_LEFT = "_left_part"
_RIGHT = "_right_part"


def hot_keys(
    key: str,
    left: DataFrame,
    right: DataFrame,
    *,
    rows: int = HOT_ROWS,
    look_at: float = LOOK_AT,
) -> DataFrame:
    """key, left_parts, right_parts of each key that has about ``rows`` rows or more on a side.

    The parts are how many times ``rows`` a side has of the key, at least 1. An estimate from
    a small sample of the key columns, so that only few keys are shuffled; the bar bounds how
    many are found. It only steers where rows are joined: a key that is missed, or taken for
    hot wrongly, is joined all the same. Every row is joined.
    """
    bar = rows * look_at

    def seen(side: DataFrame, name: str) -> DataFrame:
        looked_at = side.select(key).where(F.col(key).isNotNull()).sample(False, look_at, 0)
        return looked_at.groupBy(key).agg(F.count("*").alias(name)).where(F.col(name) >= bar)

    both = seen(left, "left_seen").join(seen(right, "right_seen"), key, "full_outer")
    return both.select(
        key,
        *[
            F.greatest(F.lit(1), F.ceil(F.coalesce(f"{side}_seen", F.lit(0)) / bar))
            .cast("int")
            .alias(f"{side}_parts")
            for side in ("left", "right")
        ],
    )


def equi_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    hot: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of whole rows on ``key``, with bag semantics and one key column.

    One shuffle join. The rows of a ``hot`` key (found by ``hot_keys`` unless given) are cut
    into its parts and meet on a grid of the key's own: a row is copied once per part
    of the other side, however many other keys are hot. Should the hot keys not fit a
    broadcast, the plain join is left to adaptive execution.

    ``left`` should be the side with few rows per key. It is put second below: a merge join
    holds one key's rows of its second side in memory.
    """
    columns = left.columns + [name for name in right.columns if name != key]
    if hot is None:
        hot = written(hot_keys(key, left, right), "hot-keys")
    if hot.isEmpty() or not fits_broadcast(hot, limit):
        return right.join(left, key).select(columns)
    parts = F.broadcast(hot.withColumnsRenamed({"left_parts": _LEFT, "right_parts": _RIGHT}))
    return (
        placed(right, parts, key, _RIGHT, _LEFT)
        .join(placed(left, parts, key, _LEFT, _RIGHT), [key, _LEFT, _RIGHT])
        .select(columns)
    )


def placed(side: DataFrame, parts: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """Each row with the number of its part in ``own``, once for each part in ``other``.

    ``parts`` has the key and how many parts there are in ``own`` and ``other``; a key that it
    lacks has one of each. Rows are placed by their hash, so a task that is run again
    places them alike; equal rows share a part, which adaptive execution can split.
    """
    # A map has no hash.
    hashed = [f.name for f in side.schema if "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*hashed), F.coalesce(own, F.lit(1))).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
    return side.join(parts, key, "left").select(
        *side.columns, part.alias(own), F.explode(copies).alias(other)
    )


def semi_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    hot: DataFrame | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of ``left`` whose key occurs in ``right``, each once.

    When the keys of ``right`` are too large to broadcast, they are made distinct; an inner
    join with them then finds each row once, and spreads hot keys of ``left``.
    """
    keys = right.select(key)
    if fits_broadcast(keys, limit):
        return left.join(F.broadcast(keys), key, "left_semi").select(left.columns)
    return equi_join(keys.distinct(), left, key, hot=hot).select(left.columns)


def first_joined_row(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """First row of the inner join in the order of all columns, nulls first; else no row.

    The join itself is never built. Its first row has the least key that both sides share,
    and within one key the join is a product, whose least row is the least left row next to
    the least right row. So the keys of both sides are grouped to find the least shared one,
    and then each side gives one row.
    """
    sides = left.select(key, F.lit(1).alias("side")).union(right.select(key, F.lit(2)))
    seen = sides.groupBy(key).agg(F.bit_or("side").alias("sides"))
    least = seen.where(F.col("sides") == 3).agg(F.min(key).alias(key))

    def first_of(side: DataFrame) -> DataFrame:
        # ``least`` is a global aggregate, so it has one row.
        rows = side.join(F.broadcast(least), key)
        order = [F.col(name).asc_nulls_first() for name in side.columns]
        return rows.orderBy(*order).limit(1)

    return first_of(left).join(first_of(right), key)
