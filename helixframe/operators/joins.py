"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DataType, DateType, MapType, NullType, NumericType, StringType, StructType,
    TimestampNTZType, TimestampType,
)

from ..session import pin

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: What any value takes, and a length or a pointer.
FIXED = 16


def _bytes_in(column: Column, kind: DataType) -> Column | None:
    """Bytes that a value holds; None for a type whose size is not known here."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.lit(FIXED) + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType, NullType)):
        return F.lit(FIXED)
    if isinstance(kind, StructType):
        parts = [_bytes_in(column[f.name], f.dataType) for f in kind.fields]
        return None if any(p is None for p in parts) else sum(parts, F.lit(FIXED))
    if isinstance(kind, MapType):
        parts = [
            _bytes_in(f(column), ArrayType(t)) for f, t in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))
        ]
        return None if any(p is None for p in parts) else parts[0] + parts[1]
    if isinstance(kind, ArrayType):
        if _bytes_in(F.lit(None), kind.elementType) is None:
            return None
        size = F.coalesce(F.size(column), F.lit(0))
        if isinstance(kind.elementType, (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)):
            return F.lit(FIXED) + size * 8
        each = F.transform(column, lambda e: _bytes_in(e, kind.elementType).cast("bigint"))
        return F.lit(FIXED) + F.coalesce(F.aggregate(each, F.lit(0).cast("bigint"), lambda n, x: n + x), F.lit(0))
    return None


def measured_bytes(df: DataFrame) -> float:
    """Size of the rows, from the real length of what they hold (an action); infinite where a type's size is not known."""
    parts = [_bytes_in(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    if any(p is None for p in parts):
        return math.inf
    return df.agg(F.coalesce(F.sum(sum(parts, F.lit(0)).cast("bigint")), F.lit(0))).first()[0]


def join_measured(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join a large side with one that is small as a rule (an action on the small side).

    The small side is computed once, pinned and measured. Below the bound it is broadcast, so
    the large side is not shuffled. Above it the join shuffles both sides and adaptive execution
    splits skewed partitions.
    """
    pinned = pin(small)
    side = F.broadcast(pinned) if measured_bytes(pinned) <= max_bytes else pinned
    return large.join(side, on, how)
