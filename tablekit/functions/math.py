"""Arithmetic for derived columns where plain Spark differs from what the formulas of an analyst mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.columns import as_double, require


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def true_div(a, b) -> Column:
    """Division of doubles: x/0 is a signed infinity, 0/0 is null."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    inf = F.lit(float("inf"))
    return F.when(b != 0, F.try_divide(a, b)).when((b == 0) & (a > 0), inf).when((b == 0) & (a < 0), -inf)


def floor_div(a, b) -> Column:
    """Rounds towards minus infinity (Spark's ``div`` cuts off)."""
    q = true_div(a, b)
    whole = F.floor(F.when(F.abs(q) != F.lit(float("inf")), q)).cast("double")
    return F.when(F.abs(q) == F.lit(float("inf")), q).otherwise(whole)


def modulo(a, b) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def power(a, b) -> Column:
    return F.pow(_col(a).cast("double"), _col(b).cast("double"))


def largest(*cols) -> Column:
    """Row-wise maximum; null when any argument is null (``greatest`` skips nulls)."""
    return _strict(F.greatest, cols)


def smallest(*cols) -> Column:
    return _strict(F.least, cols)


def _strict(fn, cols) -> Column:
    cols = [_col(c) for c in cols]
    any_null = cols[0].isNull()
    for c in cols[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, fn(*cols))


def round_even(c, digits: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(_col(c), digits)


def truncate(c) -> Column:
    c = _col(c)
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def square_root(c) -> Column:
    c = _col(c).cast("double")
    return F.when(c >= 0, F.sqrt(c))


def log(c) -> Column:
    """Natural logarithm; null for negative numbers, minus infinity for 0."""
    return _log(F.ln, c)


def log10(c) -> Column:
    return _log(F.log10, c)


def _log(fn, c) -> Column:
    c = _col(c).cast("double")
    return F.when(c > 0, fn(c)).when(c == 0, F.lit(float("-inf")))


def shift_left(c, bits: int) -> Column:
    return F.shiftleft(_col(c).cast("long"), bits)


def shift_right(c, bits: int) -> Column:
    return F.shiftright(_col(c).cast("long"), bits)


def whole_column(df: DataFrame, column: str, function: str) -> Column:
    """An aggregate of the whole column as a value usable in every row (a scalar subquery, one scan).

    ``max, min, sum, mean`` and the population forms ``std, var``; nulls and NaN are skipped. ``len`` counts rows.
    """
    aggregates = {
        "max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop,
        "len": lambda c: F.count(F.lit(1)),
    }
    return df.agg(aggregates[function](as_double(df, *require(df, [column]))).alias("v")).scalar()
