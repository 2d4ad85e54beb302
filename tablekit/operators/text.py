"""Text operators on one column. A null cell stays null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidParameter
from ..functions import text as tx
from ..plans.columns import ref, require

CASES = {"upper": F.upper, "lower": F.lower, "title": tx.title_case, "capitalize": tx.capitalize}


def _cell(df: DataFrame, column: str) -> Column:
    return ref(*require(df, [column])).cast("string")


def replaced(df: DataFrame, column: str, pattern: str, replacement: str, regex: bool = True) -> Column:
    """All matches of a regular expression (or of a literal) replaced."""
    c = _cell(df, column)
    if not regex:
        return tx.replace_literal(c, pattern, replacement)
    return F.regexp_replace(c, tx.check_regex(df.sparkSession, pattern), tx.java_replacement(replacement))


def replace_in_column(df: DataFrame, column: str, pattern: str, replacement: str, regex: bool = True) -> DataFrame:
    return df.withColumn(column, replaced(df, column, pattern, replacement, regex))


def extract_from_column(df: DataFrame, column: str, pattern: str, expand: bool = False) -> DataFrame:
    """The first match's first group, or with ``expand`` one new column ``{column}_extracted_{i}`` per group.

    A cell without a match gives null.
    """
    c = _cell(df, column)
    java = tx.check_regex(df.sparkSession, pattern)
    groups = tx.group_count(pattern)
    if groups == 0:
        raise InvalidParameter("pattern", pattern, "at least one capture group")
    found = [F.when(c.rlike(java), F.regexp_extract(c, java, i + 1)) for i in range(groups)]
    if not expand:
        return df.withColumn(column, found[0])
    return df.withColumns({f"{column}_extracted_{i}": part for i, part in enumerate(found)})


def split_column(
    df: DataFrame, column: str, delimiter: str = " ", part_index: int = 0, expand_to_columns: bool = False,
    new_columns: Sequence[str] | None = None, num_parts: int | None = None,
) -> DataFrame:
    """Part ``part_index`` of the cell, or with ``expand_to_columns`` every part in a column of its own.

    The delimiter is literal. Without ``num_parts`` the number of new columns is the largest number of parts in the
    data, which takes one aggregate to find.
    """
    c = _cell(df, column)
    if not delimiter:
        raise InvalidParameter("delimiter", delimiter, "at least one character")
    parts = F.split(c, r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
    if not expand_to_columns:
        if part_index < 0:
            raise InvalidParameter("part_index", part_index, "0 or more")
        return df.withColumn(column, F.get(parts, F.lit(part_index)))
    if num_parts is None:
        num_parts = df.agg(F.max(F.size(parts))).first()[0] or 1
        num_parts = max(num_parts, 1)
    names = list(new_columns or [])[:num_parts]
    names += [f"{column}_part_{i}" for i in range(len(names), num_parts)]
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(names)})


def transform_column_case(df: DataFrame, column: str, transform: str) -> DataFrame:
    if transform not in CASES:
        raise InvalidParameter("transform", transform, f"one of {sorted(CASES)}")
    return df.withColumn(column, CASES[transform](_cell(df, column)))


def strip_column(df: DataFrame, column: str, chars: str | None = None) -> DataFrame:
    return df.withColumn(column, tx.strip(_cell(df, column), chars))
