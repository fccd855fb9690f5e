"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import MISSING_STAT


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division of two whole numbers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def floor_to(value: Column, width: int) -> Column:
    """Round a non-negative whole number down to a multiple of ``width``."""
    return value - value % F.lit(width)


def half_even(value: Column) -> Column:
    """Round to a whole number, ties to the even neighbour."""
    return F.rint(value).cast("bigint")


def clamp(value: Column, low: int | None = None, high: int | None = None) -> Column:
    """Bound a value; a missing bound is open."""
    if low is not None:
        value = F.greatest(value, F.lit(low).cast("bigint"))
    if high is not None:
        value = F.least(value, F.lit(high).cast("bigint"))
    return value


# A cast that fails costs an exception per row, so text is matched before it is cast.
_WHOLE = r"^\s*[+-]?\d+\s*$"
_WHOLE_PART = r"^\s*([+-]?\d+)(?:\.\d*)?\s*$"
_DECIMAL = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|nan|inf(?:inity)?)\s*$"


def parse_long(text: Column) -> Column:
    """Text to bigint; NULL where it is not a whole number."""
    return F.when(text.rlike(_WHOLE), text.try_cast("bigint"))


def lenient_long(text: Column) -> Column:
    """Text to bigint; ``'57.9'`` gives 57 and text that is not a number gives NULL."""
    whole = F.regexp_extract(text, _WHOLE_PART, 1)
    return F.when(whole != "", whole.try_cast("bigint"))


def parse_double(text: Column, default: float = MISSING_STAT) -> Column:
    """Text to double, or a default where it does not parse."""
    number = F.when(text.rlike(_DECIMAL), text.try_cast("double"))
    return F.coalesce(number, F.lit(default))
