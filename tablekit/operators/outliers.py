"""Outliers of numeric columns by the quartile rule or the z-score."""

from __future__ import annotations

import operator as op
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import InvalidParameter
from ..plans.columns import INDEX, as_double, beyond, combined, numeric_columns, require
from ..plans.metrics import moments, per_column
from ..plans.quantiles import quantiles, scaled_bounds

METHODS = ("iqr", "zscore")


def _rules(df: DataFrame, names: Sequence[str], method: str, threshold: float) -> dict[str, tuple[Column, Column, Column]]:
    """Per column (candidate, is outlier, score); the candidate condition can be pushed into the scan."""
    rules = {}
    if method == "iqr":
        for name, q in quantiles(df, names, (0.25, 0.75)).items():
            bounds = scaled_bounds(q, threshold)
            if bounds:
                c, (low, high, iqr) = as_double(df, name), bounds
                distance = F.when(c < low, F.lit(low) - c).otherwise(c - F.lit(high))
                rules[name] = (*beyond(df, name, low, high), distance / F.lit(iqr) if iqr > 0 else F.lit(0.0))
    else:
        for name, m in moments(df, names).items():
            if m["std"] > 0:
                score = F.abs((as_double(df, name) - F.lit(m["mean"])) / F.lit(m["std"]))
                hit = score > F.lit(float(threshold))
                rules[name] = (hit, hit, score)
    return rules


def _numeric(df, columns, index, method):
    if method not in METHODS:
        raise InvalidParameter("method", method, f"one of {METHODS}")
    names = numeric_columns(df, columns, index)
    if not names:
        raise InvalidParameter("columns", columns, "at least one numeric column")
    return names


def detect_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float = 1.5,
    index: str = INDEX, per_column_cap: int | None = None,
) -> DataFrame:
    """(column, row index, value, score) of every outlier; the score is the distance past the bound in IQRs, or |z|.

    ``per_column_cap`` keeps the first rows of each column for a report.
    """
    names = _numeric(df, columns, index, method)
    require(df, [index])
    rules = _rules(df, names, method, threshold)
    hits = [
        F.when(hit, F.struct(F.lit(name).alias("column"), as_double(df, name).alias("value"), score.alias("score")))
        for name, (_, hit, score) in rules.items()
    ]
    if not hits:
        return df.sparkSession.createDataFrame([], f"column string, `{index}` bigint, value double, score double")
    any_hit = combined(op.or_, [candidate for candidate, _, _ in rules.values()])
    found = (
        df.filter(any_hit)
        .select(F.col(index), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x"))
        .select("x.column", index, "x.value", "x.score")
    )
    return first_per_column(found, per_column_cap, index) if per_column_cap else found


def first_per_column(found: DataFrame, cap: int, index: str = INDEX, by: Sequence[str] = ("column",)) -> DataFrame:
    """The first ``cap`` reported rows of each column, in row order."""
    if cap < 1:
        raise InvalidParameter("cap", cap, "1 or more")
    order = Window.partitionBy(*by).orderBy(index)
    return found.withColumn("__rn__", F.row_number().over(order)).filter(F.col("__rn__") <= cap).drop("__rn__")


def outlier_counts(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float = 1.5,
    index: str = INDEX,
) -> DataFrame:
    """(column, outliers) for every numeric column, from one aggregate."""
    names = _numeric(df, columns, index, method)
    rules = _rules(df, names, method, threshold)
    return per_column(df, names, lambda name: {
        "outliers": F.count_if(rules[name][1]) if name in rules else F.count_if(F.lit(False))
    })
