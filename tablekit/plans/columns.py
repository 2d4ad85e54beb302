"""Column lookup, kinds of columns, and the rule that NaN counts as null."""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import ColumnNotFound

INDEX = "__row_index__"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NUMERIC = (*INTEGRAL, *FLOATING, T.DecimalType)
TEXT = (T.StringType, T.CharType, T.VarcharType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
SCALAR = (*NUMERIC, *TEXT, *DATETIME, T.BooleanType)


def ref(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require(df: DataFrame, columns: Iterable[str]) -> list[str]:
    columns = list(columns)
    have = set(df.columns)
    for name in columns:
        if name not in have:
            raise ColumnNotFound(name, df.columns)
    return columns


def data_columns(df: DataFrame, columns: Sequence[str] | None = None, index: str = INDEX) -> list[str]:
    """The requested columns, or every column except the row index."""
    if columns:
        return require(df, columns)
    return [c for c in df.columns if c != index]


def _of_kind(df, columns, index, kinds):
    return [c for c in data_columns(df, columns, index) if isinstance(type_of(df, c), kinds)]


def numeric_columns(df, columns=None, index: str = INDEX) -> list[str]:
    return _of_kind(df, columns, index, NUMERIC)


def text_columns(df, columns=None, index: str = INDEX) -> list[str]:
    return _of_kind(df, columns, index, TEXT)


def datetime_columns(df, columns=None, index: str = INDEX) -> list[str]:
    return _of_kind(df, columns, index, DATETIME)


def boolean_columns(df, columns=None, index: str = INDEX) -> list[str]:
    return _of_kind(df, columns, index, (T.BooleanType,))


def scalar_columns(df, columns=None, index: str = INDEX) -> list[str]:
    return _of_kind(df, columns, index, SCALAR)


def type_label(dtype: T.DataType) -> str:
    """Short type name used in reports."""
    if isinstance(dtype, INTEGRAL):
        return "int64"
    if isinstance(dtype, (*FLOATING, T.DecimalType)):
        return "float64"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, DATETIME):
        return "datetime64"
    return "object"


def combined(op, parts: Sequence[Column]) -> Column:
    """``parts`` joined by a binary operator as a balanced tree, which stays shallow on very wide tables."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [op(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def value_of(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    c = ref(name)
    return F.nanvl(c, F.lit(None).cast(type_of(df, name))) if isinstance(type_of(df, name), FLOATING) else c


def comparison(df: DataFrame, name: str, value: object) -> tuple[Column, Column] | None:
    """The column and a constant as two sides that compare without an implicit cast of the data.

    Numbers and booleans compare as numbers, dates with dates or their text, text with text. None: different kinds,
    which are never equal and have no order.
    """
    c, dtype = ref(name), type_of(df, name)
    if isinstance(dtype, TEXT):
        return (c, F.lit(value)) if isinstance(value, str) else None
    if isinstance(dtype, DATETIME):
        if isinstance(value, (datetime.datetime, datetime.date)):
            return c, F.lit(str(value)).cast(dtype)
        return (c, F.lit(value).cast(dtype)) if isinstance(value, str) else None
    if isinstance(value, bool) and isinstance(dtype, T.BooleanType):
        return c, F.lit(value)
    if isinstance(value, (bool, int, float, decimal.Decimal)):
        number = F.lit(int(value) if isinstance(value, bool) else value)
        if isinstance(dtype, T.BooleanType):
            return c.cast("int"), number
        return (c, number) if isinstance(dtype, NUMERIC) else None
    return None


def equals(df: DataFrame, name: str, value: object) -> Column | None:
    """Equality with a constant; None when the column cannot hold it."""
    sides = comparison(df, name, value)
    return sides and sides[0] == sides[1]


def is_one_of(df: DataFrame, name: str, values: Iterable) -> Column:
    """Membership in a list of constants; those of another kind cannot match."""
    sides = [s for s in (comparison(df, name, v) for v in values if v is not None) if s]
    return sides[0][0].isin([literal for _, literal in sides]) if sides else F.lit(False)


def missing(df: DataFrame, name: str) -> Column:
    c = ref(name)
    return c.isNull() | F.isnan(c) if isinstance(type_of(df, name), FLOATING) else c.isNull()


def nullify_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into null in the floating-point columns."""
    names = [c for c in (columns or df.columns) if isinstance(type_of(df, c), FLOATING)]
    return df.withColumns({c: value_of(df, c) for c in names}) if names else df


def as_double(df: DataFrame, name: str) -> Column:
    c = value_of(df, name)
    return c if isinstance(type_of(df, name), T.DoubleType) else c.cast("double")


def beyond(df: DataFrame, name: str, low: float, high: float) -> tuple[Column, Column]:
    """(candidate, exact): values below ``low`` or above ``high``.

    The candidate compares the bare column with literals of its own type, which the scan can push down; it also lets
    NaN through, which the exact condition does not.
    """
    c, dtype = ref(name), type_of(df, name)
    if isinstance(dtype, INTEGRAL) and max(abs(low), abs(high)) < 2**53:
        candidate = (c < F.lit(math.ceil(low))) | (c > F.lit(math.floor(high)))
        return candidate, candidate
    candidate = (c < F.lit(low)) | (c > F.lit(high))
    return candidate, candidate & ~F.isnan(c) if isinstance(dtype, FLOATING) else candidate
