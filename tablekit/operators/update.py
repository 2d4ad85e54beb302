"""Column updates: replace, map, apply, fillna."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidParameter
from ..plans.columns import equals, missing, ref, require, type_of, value_of
from ..plans.joins import BROADCAST_ROWS, bounded, lookup_join
from ..plans.store import keep
from .project import literal_fits

#: Entries of a dictionary that go into the plan as a literal; a larger one becomes a table.
MAX_INLINE_MAPPING = 1000


def replace_values(df: DataFrame, column: str, pattern: object, replacement: object) -> DataFrame:
    """Replace cells that are equal to ``pattern`` as a whole."""
    c = ref(*require(df, [column]))
    hit = missing(df, column) if pattern is None else equals(df, column, pattern)
    if hit is None:
        return df
    return df.withColumn(column, F.when(hit, F.lit(replacement)).otherwise(c))


def map_values(df: DataFrame, column: str, mapping: Mapping | DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Look every cell up; a value that is not mapped becomes null.

    A dictionary becomes one map literal, or a table if it is large; an empty one maps everything to null. A mapping may
    also come as a DataFrame with columns ``key`` (unique) and ``value``: broadcast up to ``broadcast_rows`` rows
    (counted), above that joined with hot values spread.
    """
    c = ref(*require(df, [column]))
    if not isinstance(mapping, DataFrame):
        if not mapping:
            return df.withColumn(column, F.lit(None).cast(type_of(df, column)))
        if len(mapping) > MAX_INLINE_MAPPING:
            mapping = df.sparkSession.createDataFrame(list(mapping.items()), ["key", "value"])
    if isinstance(mapping, DataFrame):
        require(mapping, ["key", "value"])
        table = mapping.select(F.col("key").alias("__key__"), F.col("value").alias("__value__"))
        once = table.agg(F.count("__key__").alias("keys"), F.count_distinct("__key__").alias("different")).first()
        if once["keys"] != once["different"]:
            raise InvalidParameter("mapping", f"{once['keys'] - once['different']} repeated keys", "every key once")
        if (small := bounded(table, broadcast_rows)) is not table:
            joined = df.join(small, c == F.col("__key__"), "left")
        else:
            joined = _map_by_shuffle(df.withColumn("__key__", c), table)
        return joined.withColumn(column, F.col("__value__")).select(*[ref(x) for x in df.columns])
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(column, F.try_element_at(literal, c))


def _map_by_shuffle(df: DataFrame, table: DataFrame) -> DataFrame:
    """Resolve each distinct value once, then join the answers back by value. Null maps to null without a join."""
    values = df.filter("__key__ IS NOT NULL").groupBy("__key__").agg(F.count(F.lit(1)).alias("__n__"))
    resolved = keep(values.join(table, "__key__", "left"))
    known = lookup_join(df.filter("__key__ IS NOT NULL"), resolved, ["__key__"], "__n__").drop("__n__")
    empty = df.filter("__key__ IS NULL").withColumn("__value__", F.lit(None).cast(table.schema["__value__"].dataType))
    return known.unionByName(empty)


def apply_expression(df: DataFrame, column: str, expression: str | Callable[[Column], Column]) -> DataFrame:
    """Rewrite a column by a function of it, or by a SQL expression over the table's columns."""
    c = ref(*require(df, [column]))
    return df.withColumn(column, F.expr(expression) if isinstance(expression, str) else expression(c))


def fill_column_nulls(df: DataFrame, column: str, value: object) -> DataFrame:
    require(df, [column])
    if value is None or not literal_fits(value, type_of(df, column)):
        raise InvalidParameter("value", value, f"a constant of type {type_of(df, column).simpleString()}")
    return df.withColumn(column, F.coalesce(value_of(df, column), F.lit(value).cast(type_of(df, column))))


def update_column(df: DataFrame, column: str, operation: str, **arguments) -> DataFrame:
    """One entry point for ``replace`` / ``map`` / ``apply`` / ``fillna``."""
    operations = {
        "replace": replace_values, "map": map_values, "apply": apply_expression, "fillna": fill_column_nulls,
    }
    if operation not in operations:
        raise InvalidParameter("operation", operation, f"one of {sorted(operations)}")
    return operations[operation](df, column, **arguments)


def rows_changed(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """rows_affected: how many rows an update of one column changes."""
    return df.agg(F.count_if(~before.eqNullSafe(after)).alias("rows_affected"))
