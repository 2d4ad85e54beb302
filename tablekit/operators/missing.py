"""Missing values: drop, constant, neighbours in row order, and column statistics."""

from __future__ import annotations

import operator as op
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import InvalidParameter
from ..plans.columns import (
    INDEX, as_double, combined, data_columns, missing, numeric_columns, ref, require, type_of, value_of,
)
from ..plans.metrics import column_tops
from ..plans.order import BLOCK, BLOCK_BITS, block_of, index_span, last_before
from ..plans.quantiles import quantiles
from ..plans.store import keep
from .project import literal_fits

STRATEGIES = ("drop", "fill", "forward", "backward", "mean", "median", "mode")


def fill_missing_values(
    df: DataFrame, strategy: str = "drop", value: object = None, columns: Sequence[str] | None = None,
    index: str = INDEX, block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Repair missing cells. ``forward`` and ``backward`` follow the unique integer column ``index``."""
    targets = data_columns(df, columns, index)
    if strategy == "drop":
        return _drop(df, targets)
    if strategy == "fill":
        return _constant(df, targets, value)
    if strategy in ("forward", "backward"):
        return _neighbour(df, targets, index, strategy == "backward", block_bits)
    if strategy == "mean":
        return _mean(df, numeric_columns(df, targets, index))
    if strategy == "median":
        return _median(df, numeric_columns(df, targets, index))
    if strategy == "mode":
        return _mode(df, targets)
    raise InvalidParameter("strategy", strategy, f"one of {STRATEGIES}")


def _drop(df, targets):
    return df.filter(~combined(op.or_, [missing(df, c) for c in targets])) if targets else df


def _constant(df, targets, value):
    if value is None:
        raise InvalidParameter("value", value, "a constant for the 'fill' strategy")
    for c in targets:
        if not literal_fits(value, type_of(df, c)):
            raise InvalidParameter("value", value, f"a constant that fits {c}: {type_of(df, c).simpleString()}")
    return df.withColumns({c: F.coalesce(value_of(df, c), F.lit(value).cast(type_of(df, c))) for c in targets})


def _filled(df: DataFrame, name: str, value: Column) -> Column:
    return F.coalesce(value_of(df, name), value.cast(type_of(df, name)))


def _mean(df, targets):
    """All means from one aggregate, used as a scalar subquery. Integer columns become double, as their mean is."""
    if not targets:
        return df
    means = df.agg(F.struct(*[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(targets)]).alias("m"))
    row = means.scalar()
    return df.withColumns({c: F.coalesce(as_double(df, c), row.getField(f"m{i}")) for i, c in enumerate(targets)})


def _median(df, targets):
    medians = quantiles(df, targets, [0.5])
    return df.withColumns({
        c: F.coalesce(as_double(df, c), F.lit(medians[c][0.5])) for c in targets if medians[c][0.5] is not None
    })


def _mode(df, targets):
    """The most frequent value of every column from one histogram; ties go to the smallest value."""
    best = column_tops(df, targets, nulls=False) if targets else {}
    updates = {}
    for i, c in enumerate(targets):
        if i in best:
            v = best[i]
            found = next((v[k] for k in ("l", "s", "d") if v[k] is not None), None)
            updates[c] = _filled(df, c, F.lit(found))
    return df.withColumns(updates)


def _neighbour(df, targets, index, backward, bits):
    """Carry the last (or next) known value along the row order.

    Inside a block by a window partitioned by block; the last known value of every block is carried to later blocks.
    """
    require(df, [index])
    span = index_span(df, index)
    if span is None or not targets:
        return df
    lo, hi = span
    last_block = (hi >> bits) - (lo >> bits)
    number = block_of(ref(index), lo, bits)
    block = F.lit(last_block) - number if backward else number
    order = ref(index).desc() if backward else ref(index).asc()
    inside = Window.partitionBy(BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    names = {f"__f{i}__": c for i, c in enumerate(targets)}
    rows = df.withColumns({BLOCK: block, **{k: value_of(df, c) for k, c in names.items()}})
    filled = rows.withColumns({k: F.last(k, True).over(inside) for k in names})
    if last_block > 0:
        at = -ref(index) if backward else ref(index)
        ends = rows.groupBy(BLOCK).agg(
            *[F.max_by(k, F.when(F.col(k).isNotNull(), at)).alias(k) for k in names]
        )
        if last_block >> bits:
            ends = keep(ends)  # read several times; one row per block
        carried = last_before(ends, BLOCK, list(names), last_block, bits)
        carried = carried.withColumnsRenamed({k: f"__c{k}" for k in names})
        filled = filled.join(carried, BLOCK)
        filled = filled.withColumns({k: F.coalesce(F.col(k), F.col(f"__c{k}")) for k in names})
    by_column = {c: k for k, c in names.items()}
    return filled.select(*[F.col(by_column[c]).alias(c) if c in by_column else ref(c) for c in df.columns])


def values_filled(df: DataFrame, after: DataFrame, columns: Sequence[str] | None = None, index: str = INDEX) -> DataFrame:
    """rows_affected (rows afterwards) and values_filled (missing cells that are gone)."""
    targets = data_columns(df, columns, index)

    def cells(frame):
        return combined(op.add, [F.lit(0).cast("long"), *[F.count_if(missing(frame, c)) for c in targets]])

    before = df.agg(cells(df).alias("n")).scalar()
    return after.agg(F.count(F.lit(1)).alias("rows_affected"), cells(after).alias("__left__")).select(
        "rows_affected", (before - F.col("__left__")).alias("values_filled")
    )


