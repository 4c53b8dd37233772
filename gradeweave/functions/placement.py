"""Columns that place a row on one axis of a join grid: an integer in [0, k)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_cell(k: int, seed: int) -> Column:
    """Uniform draw. A re-run task may draw again; see ``operators.theta`` for the remedy."""
    return F.floor(F.rand(seed) * k).cast("int")


def hashed_cell(k: int, key: Sequence[str], seed: int) -> Column:
    """Uniform over distinct keys, and the same however often a task is re-run."""
    hashed = F.xxhash64(F.lit(seed), *[F.col(name) for name in key])
    return F.pmod(hashed, F.lit(k)).cast("int")
