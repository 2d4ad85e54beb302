"""Row filters from conditions (column, operator, value).

A condition is true or false, never null: a null cell fails every comparison except the negative ones. Positive
predicates are left bare, because a filter drops null like false; that way Catalyst pushes them into the scan.
"""

from __future__ import annotations

import operator as op
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidParameter
from ..functions.text import check_regex
from ..plans.columns import FLOATING, combined, comparison, equals, is_one_of, missing, ref, require, type_of, value_of

# The names of the operators.
OPERATORS = (
    "=", "==", "!=", "not_equals", ">", "<", ">=", "<=", "contains", "not_contains", "starts_with", "ends_with",
    "in", "not_in", "is_null", "is_not_null",
)


LISTS = ("in", "not_in")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any = None


def _as_condition(c: Condition | dict | tuple) -> Condition:
    if isinstance(c, Condition):
        return c
    return Condition(**c) if isinstance(c, dict) else Condition(*c)


def _condition(df: DataFrame, cond: Condition) -> Column:
    (name,) = require(df, [cond.column])
    c, v, o = ref(name), cond.value, cond.operator
    floating = isinstance(type_of(df, name), FLOATING)
    text = value_of(df, name).cast("string")
    if o not in OPERATORS:
        raise InvalidParameter("operator", o, f"one of {OPERATORS}")
    same = None if v is None or o in LISTS else equals(df, name, v)
    if o in ("=", "=="):
        return F.lit(False) if same is None else same
    if o in ("!=", "not_equals"):
        return F.lit(True) if same is None else c.isNull() | ~same
    if o in (">", ">=", "<", "<="):
        sides = comparison(df, name, v)
        if sides is None:
            raise InvalidParameter("value", v, f"a value that compares with {name}: {type_of(df, name).simpleString()}")
        bound = {">": op.gt, ">=": op.ge, "<": op.lt, "<=": op.le}[o](*sides)
        # NaN sorts above every number in Spark, but counts as null here
        return bound & ~F.isnan(c) if floating and o in (">", ">=") else bound
    if o == "contains":
        return text.rlike(check_regex(df.sparkSession, str(v)))
    if o == "not_contains":
        return ~F.coalesce(text.rlike(check_regex(df.sparkSession, str(v))), F.lit(False))
    if o == "starts_with":
        return text.startswith(str(v))
    if o == "ends_with":
        return text.endswith(str(v))
    if o in LISTS:
        values = list(v) if isinstance(v, (list, tuple, set, frozenset)) else [v]
        hit = is_one_of(df, name, values)
        if o == "in":
            return hit | missing(df, name) if None in values else hit
        hit = F.coalesce(hit, F.lit(False))
        return ~(hit | missing(df, name)) if None in values else c.isNull() | ~hit
    return missing(df, name) if o == "is_null" else ~missing(df, name)


def predicate(df: DataFrame, conditions: Iterable[Condition | dict | tuple], mode: str = "and") -> Column:
    """The combined condition; no condition keeps every row for ``and`` and none for ``or``."""
    if mode not in ("and", "or"):
        raise InvalidParameter("mode", mode, "and / or")
    parts = [_condition(df, _as_condition(c)) for c in conditions]
    if not parts:
        return F.lit(mode == "and")
    return combined(op.and_ if mode == "and" else op.or_, parts)


def filter_rows(df: DataFrame, conditions: Sequence[Condition | dict | tuple], mode: str = "and") -> DataFrame:
    return df.filter(predicate(df, conditions, mode))


def filter_counts(df: DataFrame, conditions: Sequence[Condition | dict | tuple], mode: str = "and") -> DataFrame:
    """rows_before, rows_after, rows_filtered from one scan."""
    hit = F.count_if(predicate(df, conditions, mode))
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"), hit.alias("rows_after"),
        (F.count(F.lit(1)) - hit).alias("rows_filtered"),
    )
