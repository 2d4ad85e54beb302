"""Casts with ``coerce`` (bad values become null) and ``raise`` (bad values fail the job)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..errors import InvalidParameter

# The spellings of a number.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL = r"^\s*([+-]?(?i:inf|infinity)|(?i:nan))\s*$"
TARGETS = ("int", "float", "str", "bool", "datetime")


def text_to_double(c: Column) -> Column:
    """Text as a double, null where it is no number. The pattern comes first: a cast that fails is far slower."""
    return F.when(c.rlike(NUMBER), c.try_cast("double")).when(c.rlike(SPECIAL), c.try_cast("double"))


def cast_column(c: Column, source: T.DataType, target: str, errors: str = "coerce", fmt: str | None = None) -> Column:
    if target not in TARGETS:
        raise InvalidParameter("dtype", target, f"one of {TARGETS}")
    if errors not in ("coerce", "raise"):
        raise InvalidParameter("errors", errors, "coerce or raise")
    coerce = errors == "coerce"
    text = isinstance(source, T.StringType)
    if target == "str":
        return c.cast("string")
    if target == "float":
        value = c.cast("double") if not coerce else text_to_double(c) if text else c.try_cast("double")
        return F.nanvl(value, F.lit(None).cast("double"))
    if target == "int":
        return _to_int(c, source, coerce)
    if target == "bool":
        if isinstance(source, T.NumericType):
            return c != F.lit(0)
        return c.try_cast("boolean") if coerce or not text else c.cast("boolean")
    if coerce:
        return F.try_to_timestamp(c.cast("string"), F.lit(fmt)) if fmt else c.try_cast("timestamp_ntz")
    return F.to_timestamp_ntz(c.cast("string"), F.lit(fmt)) if fmt else c.cast("timestamp_ntz")


def _to_int(c: Column, source: T.DataType, coerce: bool) -> Column:
    """Fractions are cut off; whole numbers keep all their digits."""
    if isinstance(source, (T.IntegralType, T.BooleanType)):
        return c.cast("long")
    if not coerce:
        return F.coalesce(c.try_cast("long"), c.cast("double").cast("long")) if isinstance(source, T.StringType) \
            else c.cast("long")
    if isinstance(source, T.StringType):
        return F.coalesce(c.try_cast("long"), text_to_double(c).try_cast("long"))
    return c.try_cast("long")
