"""Measured sizes, for deciding whether a join side may be broadcast."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

BROADCAST_BYTES = 64 * 1024 * 1024

_FIXED_WIDTH = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


class Size(NamedTuple):
    rows: int
    bytes: int


def measure(df: DataFrame) -> Size:
    """Count the rows and their bytes in one distributed aggregate.

    Eight bytes per fixed-width cell, the byte length of each text, sixteen per row; an
    array, map or struct counts as its JSON text. This runs a job over ``df``; each task
    returns one partial sum, no rows move.
    """
    variable = []
    fixed = 16
    for field in df.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            variable.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)))
            fixed += 16
        elif isinstance(field.dataType, _FIXED_WIDTH):
            fixed += 8
        else:
            variable.append(F.octet_length(F.to_json(F.struct(F.col(field.name)))))
            fixed += 16
    text = sum(variable, F.lit(0).cast("long"))
    if not variable:
        rows = df.count()
        return Size(rows, rows * fixed)
    row = df.agg(F.count("*").alias("rows"), F.sum(text).alias("text")).first()
    return Size(row["rows"], row["rows"] * fixed + (row["text"] or 0))


def is_small(size: Size, limit: int = BROADCAST_BYTES) -> bool:
    """The measured size is within the broadcast bound."""
    return size.bytes <= limit


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return is_small(measure(df), limit)
