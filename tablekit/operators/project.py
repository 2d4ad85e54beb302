"""Choosing, naming, adding and casting columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import InvalidParameter
from ..functions.casts import cast_column
from ..plans.columns import INDEX, ref, require


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[ref(c) for c in require(df, columns)])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    require(df, mapping)
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise InvalidParameter("mapping", dict(mapping), "names that stay unique")
    return df.withColumnsRenamed(dict(mapping))


def remove_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*require(df, columns))


def add_column(
    df: DataFrame, name: str, value: object = None, formula: str | Column | None = None
) -> DataFrame:
    """A constant column, or one computed from other columns by a SQL expression or a ``Column``."""
    if name in df.columns:
        raise InvalidParameter("name", name, "a column that does not exist yet")
    if formula is None:
        return df.withColumn(name, F.lit(value))
    return df.withColumn(name, F.expr(formula) if isinstance(formula, str) else formula)


def add_column_values(df: DataFrame, name: str, values: DataFrame, index: str = INDEX) -> DataFrame:
    """One value per row: ``values`` holds the row index and a column ``value``, exactly one row per row of ``df``."""
    require(df, [index])
    require(values, [index, "value"])
    if name in df.columns:
        raise InvalidParameter("name", name, "a column that does not exist yet")
    # Every row number must come once from either side; one aggregate of numbers alone checks it.
    sides = df.select(index, F.lit(1).alias("__mine__")).unionByName(values.select(index, F.lit(0).alias("__mine__")))
    counted = sides.groupBy(index).agg(F.sum("__mine__").alias("mine"), F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.expr("mine <> 1 or n <> 2")).alias("unmatched")
    ).first()
    if counted["unmatched"]:
        raise InvalidParameter("values", f"{counted['unmatched']} rows without exactly one value", "exactly one value for every row")
    return df.join(values.select(index, F.col("value").alias(name)), index, "left")


def change_column_type(
    df: DataFrame, column: str, dtype: str, errors: str = "coerce", fmt: str | None = None
) -> DataFrame:
    """Cast to int, float, str, bool or datetime; ``coerce`` turns bad values into null, ``raise`` fails on them."""
    require(df, [column])
    return df.withColumn(column, cast_column(ref(column), df.schema[column].dataType, dtype, errors, fmt))


def literal_fits(value: object, dtype: T.DataType) -> bool:
    """Whether a Python constant can be stored in a column of this type without changing kind."""
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, int):
        return isinstance(dtype, T.NumericType)
    if isinstance(value, float):
        return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)) or (
            isinstance(dtype, T.IntegralType) and value.is_integer()
        )
    if isinstance(value, str):
        return isinstance(dtype, T.StringType)
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
