"""Descriptive statistics of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.columns import (
    INDEX, as_double, data_columns, numeric_columns, scalar_columns, type_label, type_of,
)
from ..plans.metrics import NO_TOP, column_tops, per_column, slot_text
from ..plans.quantiles import quantiles_and

QUARTILES = (0.25, 0.5, 0.75)
APPROXIMATE = 10_000  # accuracy of the quartiles with exact=False
_STATISTICS = "column string, count bigint, mean double, std double, min double, p25 double, p50 double, " \
              "p75 double, max double"


def get_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, index: str = INDEX
) -> DataFrame:
    """One row per numeric column: count, mean, std, min, quartiles, max; undefined values are 0.0.

    Other columns are left out. ``exact=False`` takes the quartiles from a bounded sketch in the same single scan.
    """
    return _numeric_rows(df, numeric_columns(df, columns, index), exact, 0.0)


def _moments(df, name):
    c, zero = as_double(df, name), F.lit(0.0)
    return {
        "count": F.count(c), "mean": F.coalesce(F.avg(c), zero), "std": F.coalesce(F.stddev_samp(c), zero),
        "min": F.coalesce(F.min(c), zero), "max": F.coalesce(F.max(c), zero),
    }


def _numeric_rows(df, numeric, exact, undefined):
    """Moments and quartiles; the moments come from the first scan of the quartile search. One row per column."""
    if exact:
        wanted = {(c, k): v for c in numeric for k, v in _moments(df, c).items()}
        found, m = quantiles_and(df, numeric, QUARTILES, wanted)
        quartile = lambda c, p: undefined if found[c][p] is None else found[c][p]
        rows = [
            (c, m[c, "count"], m[c, "mean"], m[c, "std"], m[c, "min"], *[quartile(c, p) for p in QUARTILES], m[c, "max"])
            for c in numeric
        ]
        return df.sparkSession.createDataFrame(rows, _STATISTICS)
    if not numeric:
        return df.sparkSession.createDataFrame([], _STATISTICS)

    def metrics(name):
        sketched = {
            f"p{round(p * 100)}": F.coalesce(F.percentile_approx(as_double(df, name), p, APPROXIMATE), F.lit(undefined))
            for p in QUARTILES
        }
        return _moments(df, name) | sketched

    return per_column(df, numeric, metrics).select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def get_column_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, index: str = INDEX
) -> DataFrame:
    """Every requested column: numeric statistics or the most frequent value, and the distinct count.

    Numeric columns have no ``top`` / ``freq``, all others no moments and quartiles.
    """
    names = scalar_columns(df, data_columns(df, columns, index), index)
    numeric = numeric_columns(df, names, index) if names else []
    tops = column_tops(df, names, nulls=False) if names else {}
    numbers = _numeric_rows(df, numeric, exact, None).withColumnRenamed("column", "name")
    labels = df.sparkSession.createDataFrame(
        [
            (c, type_label(type_of(df, c)), x["rows"], x["uniques"], *((None, None) if c in numeric else (slot_text(x), x["n"])))
            for i, c in enumerate(names) for x in [tops.get(i, {**NO_TOP, "rows": 0, "uniques": 0})]
        ],
        "column string, data_type string, known long, unique long, top string, freq long",
    )
    # both hold one row per column
    return labels.join(numbers, F.col("column") == F.col("name"), "left").select(
        "column", "data_type", F.col("known").alias("count"), "unique", "mean", "std", "min", "p25", "p50", "p75", "max", "top", "freq"
    )
