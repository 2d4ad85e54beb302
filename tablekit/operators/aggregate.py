"""Grouped aggregation and value counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import InvalidParameter
from ..plans.columns import INDEX, INTEGRAL, as_double, missing, numeric_columns, ref, require, type_of, value_of
from ..plans.order import running_sums

FUNCTIONS = ("count", "mean", "median", "sum", "min", "max", "std", "var", "first", "last", "nunique")
# The built-in percentile keeps a group's distinct values in one buffer; it is used up to this many of them.
GROUP_DISTINCT_LIMIT = 1_000_000
# Where a column's absolute values add up to less than this, no sum of some of them leaves 64 bits.
SAFE_TOTAL = 2.0**62


def _aggregate(df: DataFrame, name: str, function: str, index: str, large: Mapping[str, bool]) -> Column:
    c = value_of(df, name)
    if function in ("first", "last"):
        if index not in df.columns:
            raise InvalidParameter("index", index, "a row order for first / last")
        at = F.when(c.isNotNull(), ref(index))
        return F.min_by(c, at) if function == "first" else F.max_by(c, at)
    if function == "sum" and name in large:
        total = F.coalesce(_wide_sum(c), F.lit(0).cast("decimal(38,0)"))
        return total.cast("long") if large[name] else total
    if function == "sum":
        total = F.sum(c)  # keeps the kind of its column: whole numbers, decimals or doubles
        return F.coalesce(total, F.lit(0).cast(_sum_type(type_of(df, name))))
    plain = {
        "count": F.count, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
        "nunique": F.count_distinct, "median": lambda x: F.percentile(x.cast("double"), 0.5),
    }
    return plain[function](c)


def _sum_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.DecimalType):
        return T.DecimalType(min(38, dtype.precision + 10), dtype.scale)
    return T.LongType() if isinstance(dtype, INTEGRAL) else T.DoubleType()


def _wide_sum(c: Column) -> Column:
    """The exact sum of whole numbers, decimal(38,0)."""
    return F.sum(c.cast("decimal(28,0)"))


def _large_sums(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> dict[str, bool]:
    """The whole-number columns that 64 bits may not be enough to sum up, each with whether all groups' sums fit in them after all.

    One pass without a shuffle finds the columns; only these are summed beforehand. A stream can't be.
    """
    columns = [c for c in columns if isinstance(type_of(rows, c), (T.IntegerType, T.LongType))]
    if not columns or rows.isStreaming:
        return {}
    totals = rows.agg(*[F.sum(F.abs(ref(c).cast("double"))) for c in columns]).first()
    large = [c for c, total in zip(columns, totals) if (total or 0.0) >= SAFE_TOTAL]
    if not large:
        return {}
    sums = rows.groupBy(*[ref(k) for k in keys]).agg(*[_wide_sum(ref(c)).alias(f"__s{i}__") for i, c in enumerate(large)])
    ends = sums.agg(*[F.struct(F.min(f"__s{i}__").alias("low"), F.max(f"__s{i}__").alias("high")) for i in range(len(large))]).first()
    return {c: -(1 << 63) <= (end["low"] or 0) and (end["high"] or 0) < 1 << 63 for c, end in zip(large, ends)}


def group_by_aggregate(
    df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, str | Sequence[str]], index: str = INDEX,
    distinct_limit: int = GROUP_DISTINCT_LIMIT,
) -> DataFrame:
    """One row per group with ``{column}_{function}`` columns; rows with a null key are left out.

    Sums are exact for whole numbers: long, or decimal(38,0) for a column of which some group's sum doesn't fit in 64 bits.
    """
    keys = require(df, group_by)
    require(df, aggregations)
    wanted = [(c, f) for c, fs in aggregations.items() for f in ([fs] if isinstance(fs, str) else fs)]
    for _, f in wanted:
        if f not in FUNCTIONS:
            raise InvalidParameter("aggregations", f, f"one of {FUNCTIONS}")
    if not wanted:
        raise InvalidParameter("aggregations", dict(aggregations), "at least one function")
    rows = _with_keys(df, keys)
    medians = list(dict.fromkeys(c for c, f in wanted if f == "median"))
    far = medians if medians and _too_wide(rows, keys, medians, distinct_limit) else []
    near = [(c, f) for c, f in wanted if not (f == "median" and c in far)]
    large = _large_sums(rows, keys, list(dict.fromkeys(c for c, f in wanted if f == "sum")))
    result = rows.groupBy(*[ref(k) for k in keys]).agg(
        *[_aggregate(df, c, f, index, large).alias(f"{c}_{f}") for c, f in near], F.count(F.lit(1)).alias("__rows__")
    )
    if far:
        result = result.join(group_medians(rows, keys, far), keys, "left")
    return result.select(*[ref(k) for k in keys], *[ref(f"{c}_{f}") for c, f in wanted])


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    present = None
    for k in keys:
        present = ~missing(df, k) if present is None else present & ~missing(df, k)
    return df.filter(present) if keys else df


def _too_wide(rows: DataFrame, keys, columns, limit) -> bool:
    if rows.count() <= limit:
        return False
    per_group = rows.groupBy(*[ref(k) for k in keys]).agg(
        F.greatest(*[F.approx_count_distinct(ref(c)) for c in columns], F.lit(0)).alias("d")
    )
    return (per_group.agg(F.max("d")).first()[0] or 0) > limit


def group_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact medians of groups of any size: ``keys`` and ``{column}_median``.

    Rows become (key, column, value, count); running counts over that histogram are range-partitioned, so one group
    may span many tasks. The row that holds the middle rank gives the median.
    """
    keys = list(keys)
    cells = F.array(*[F.struct(F.lit(i).alias("__c__"), as_double(df, c).alias("__v__")) for i, c in enumerate(columns)])
    hist = (
        df.select(*[ref(k) for k in keys], F.explode(cells).alias("__x__"))
        .select(*[ref(k) for k in keys], "__x__.*").filter("__v__ IS NOT NULL")
        .groupBy(*[ref(k) for k in keys], "__c__", "__v__").agg(F.count(F.lit(1)).alias("__n__"))
    )
    ranked = running_sums(hist, [*keys, "__c__"], ["__v__"], {"__before__": "__n__"}, {"__total__": "__before__"})
    at = (F.col("__total__") - 1) / F.lit(2.0)
    holds = lambda rank: (F.col("__before__") <= rank) & (rank < F.col("__before__") + F.col("__n__"))
    middle = ranked.select(
        *keys, "__c__", F.when(holds(F.floor(at)), F.col("__v__")).alias("__low__"),
        F.when(holds(F.ceil(at)), F.col("__v__")).alias("__high__"),
    ).filter("__low__ IS NOT NULL OR __high__ IS NOT NULL")
    return middle.groupBy(*keys).agg(*[
        ((F.max(F.when(F.col("__c__") == i, F.col("__low__"))) + F.max(F.when(F.col("__c__") == i, F.col("__high__")))) / 2)
        .alias(f"{c}_median") for i, c in enumerate(columns)
    ])


def group_stats(df: DataFrame, group_by: Sequence[str], index: str = INDEX) -> DataFrame:
    """Per group: its rows, and mean / sum / min / max / std of the table's first numeric column."""
    keys = require(df, group_by)
    numeric = numeric_columns(df, None, index)
    stats = [F.count(F.lit(1)).alias("count")]
    if numeric:
        c = as_double(df, numeric[0])
        stats += [F.avg(c).alias("mean"), F.sum(c).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"),
                  F.stddev_samp(c).alias("std")]
    groups = _with_keys(df, keys).groupBy(*[ref(k).alias(f"__k{i}__") for i, k in enumerate(keys)]).agg(*stats)
    names = [F.col(f"__k{i}__") for i in range(len(keys))]
    return groups.select(
        F.concat_ws("_", *[n.cast("string") for n in names]).alias("group_key"),
        *[n.alias(k) for n, k in zip(names, keys) if k not in groups.columns and k != "group_key"],
        *[c for c in groups.columns if not c.startswith("__k")],
    )


def value_counts(
    df: DataFrame, column: str, normalize: bool = False, sort: bool = True, ascending: bool = False,
    top_n: int | None = None,
) -> DataFrame:
    """Frequencies of the non-null values: value, count (or share), total_values, unique_values.

    Equal counts are ordered by value. With ``top_n`` only the first rows are kept.
    """
    require(df, [column])
    counts = df.select(value_of(df, column).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(
        F.count(F.lit(1)).alias("count")
    )
    overall = counts.agg(F.struct(F.coalesce(F.sum("count"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("u")).alias("x"))
    total = overall.scalar()
    if sort or top_n:
        n = F.col("count").asc() if ascending else F.col("count").desc()
        counts = counts.orderBy(n, F.col("value").asc()) if sort else counts.orderBy("value")
    if top_n is not None and top_n > 0:
        counts = counts.limit(top_n)
    frequency = (F.col("count") / total.getField("t")).alias("share") if normalize else F.col("count")
    return counts.select(
        "value", frequency, total.getField("t").alias("total_values"), total.getField("u").alias("unique_values")
    )


