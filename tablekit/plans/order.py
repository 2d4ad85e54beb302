"""Row order without a single-partition window.

A table's order is a unique integer column (``__row_index__``). Rows are cut into blocks of at most
``2**BLOCK_BITS`` consecutive integers, so a block can never be skewed, whatever the data. A running value is then
computed inside each block, one summary row per block is carried across the blocks by the same method, and both are
joined on the block. The table itself is shuffled once, on the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import InvalidParameter
from .columns import INDEX, INTEGRAL, ref, require, type_of
from .store import keep

BLOCK_BITS = 17
BLOCK, PART, POS = "__block__", "__part__", "__pos__"
LOCAL_BITS = 33  # monotonically_increasing_id keeps the position inside a partition in the low 33 bits


def index_span(df: DataFrame, by: str) -> tuple[int, int] | None:
    lo, hi = df.agg(F.min(ref(by)), F.max(ref(by))).first()
    return None if lo is None else (lo, hi)


def block_of(key: Column, lo: int, bits: int) -> Column:
    """Number of the block that holds ``key``; block 0 holds ``lo``."""
    return F.shiftright(key.cast("long"), bits) - F.lit(lo >> bits)


def _before(key: str, bits: int) -> Window:
    return Window.partitionBy(F.shiftright(F.col(key), bits)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)


def sums_before(table: DataFrame, key: str, values: Sequence[str], last_key: int, bits: int = BLOCK_BITS) -> DataFrame:
    """For unique integers ``key`` in 0..last_key: the sums of ``values`` over all smaller keys."""
    w, up = _before(key, bits), f"{key}up__"
    here = table.select(
        key, F.shiftright(F.col(key), bits).alias(up),
        *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(v) for v in values],
    )
    if last_key >> bits == 0:
        return here.drop(up)
    upper = table.groupBy(F.shiftright(F.col(key), bits).alias(up)).agg(*[F.sum(v).alias(v) for v in values])
    upper = sums_before(upper, up, values, last_key >> bits, bits)
    upper = upper.withColumnsRenamed({v: f"__above__{v}" for v in values})
    return here.join(upper, up).select(key, *[(F.col(v) + F.col(f"__above__{v}")).alias(v) for v in values])


def last_before(table: DataFrame, key: str, values: Sequence[str], last_key: int, bits: int = BLOCK_BITS) -> DataFrame:
    """For unique integers ``key`` in 0..last_key: the last non-null of each value among the smaller keys."""
    w, up = _before(key, bits), f"{key}up__"
    here = table.select(
        key, F.shiftright(F.col(key), bits).alias(up), *[F.last(v, True).over(w).alias(v) for v in values]
    )
    if last_key >> bits == 0:
        return here.drop(up)
    upper = table.groupBy(F.shiftright(F.col(key), bits).alias(up)).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(key))).alias(v) for v in values]
    )
    upper = last_before(upper, up, values, last_key >> bits, bits)
    upper = upper.withColumnsRenamed({v: f"__above__{v}" for v in values})
    return here.join(upper, up).select(
        key, *[F.coalesce(F.col(v), F.col(f"__above__{v}")).alias(v) for v in values]
    )


def renumber(df: DataFrame, by: str = INDEX, index: str = INDEX, bits: int = BLOCK_BITS) -> DataFrame:
    """Number the rows 0..n-1 in the order of the unique integer column ``by``. One shuffle, on the block."""
    require(df, [by])
    if not isinstance(type_of(df, by), INTEGRAL):
        raise InvalidParameter("by", by, "a unique integer column; use with_row_index for any other order")
    span = index_span(df, by)
    if span is None:
        return _put_index(df, F.lit(0).cast("long"), index)
    lo, hi = span
    rows = df.withColumn(BLOCK, block_of(ref(by), lo, bits))
    position = F.row_number().over(Window.partitionBy(BLOCK).orderBy(ref(by))).cast("long") - 1
    last_block = (hi >> bits) - (lo >> bits)
    if last_block == 0:
        return _put_index(rows.withColumn(POS, position), F.col(POS), index).drop(BLOCK, POS)
    counts = rows.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("__n__"))
    if last_block >> bits:
        counts = keep(counts)  # read several times; one row per block
    offsets = sums_before(counts, BLOCK, ["__n__"], last_block, bits)
    rows = rows.withColumn(POS, position).join(offsets, BLOCK)
    return _put_index(rows, F.col("__n__") + F.col(POS), index).drop(BLOCK, POS, "__n__")


def _put_index(df: DataFrame, value: Column, index: str) -> DataFrame:
    return df.withColumn("__new_index__", value).select(
        F.col("__new_index__").alias(index),
        *[ref(c) for c in df.columns if c != index],
    )


def with_row_index(
    df: DataFrame, order_by: str | Column | Sequence[str | Column] | None = None, index: str = INDEX,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add a dense 0-based row number.

    ``order_by`` one unique integer column: blocks, nothing is written. Any other order: range partitions, written
    once because range boundaries are sampled. No order: the rows as Spark delivers them, written once with their
    position. ``sources.read_parquet`` numbers files without either.
    """
    if order_by is None:
        rows = keep(df.withColumn(POS, F.monotonically_increasing_id()))
        rows = rows.withColumn(PART, F.shiftright(POS, LOCAL_BITS).cast("int"))
        return _offset_parts(rows.withColumn(POS, F.col(POS).bitwiseAND((1 << LOCAL_BITS) - 1)), index)
    if isinstance(order_by, str) and isinstance(type_of(df, *require(df, [order_by])), INTEGRAL):
        return renumber(df, by=order_by, index=index, bits=bits)
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    df, parts = _sized(df)
    return _offset_parts(sorted_parts(df, keys), index, parts - 1)


def sorted_parts(df: DataFrame, keys: Sequence[str | Column], fineness: int = 1) -> DataFrame:
    """Globally sorted, written table with the partition number and the position inside the partition.

    ``fineness`` times the usual number of partitions: a later shuffle by partition number is then more even. Make ``keys`` unique (end with the row index): equal keys always land in one partition.
    """
    keys = [ref(k) if isinstance(k, str) else k for k in keys]
    df, parts = _sized(df)
    rows = df.repartitionByRange(parts * fineness, *keys).sortWithinPartitions(*keys)
    local = F.monotonically_increasing_id().bitwiseAND((1 << LOCAL_BITS) - 1)
    return keep(rows.withColumns({PART: F.spark_partition_id(), POS: local}))


#: Bytes of input for one range partition, and an estimate beyond which the planner is taken not to know the size.
PART_BYTES, UNKNOWN_BYTES = 256 << 20, 1 << 57
#: Operators behind which the planner's size is a guess, such as the product of a join's sides.
_GUESSED = ("Join", "Generate", "Expand", "Aggregate", "Window")


def _sized(df: DataFrame) -> tuple[DataFrame, int]:
    """The table, and as many partitions as shuffles have, or more if its size asks for them.

    Sizes of files and of what is selected from them are measured. Where the planner guesses that more partitions are needed than there are, the
    table is written, and the size of what was written counts.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, plan = _planned(df)
    if size > least * PART_BYTES and (size > UNKNOWN_BYTES or any(name in plan for name in _GUESSED)):
        df = keep(df)
        size, _ = _planned(df)
    return df, max(least, -(-size // PART_BYTES))


def _planned(df: DataFrame) -> tuple[int, str]:
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())), plan.toString()


def _offset_parts(rows: DataFrame, index: str, last_part: int = (1 << 31) - 1) -> DataFrame:
    """Global index from (partition, position). There are as many offsets as partitions, so they are broadcast."""
    counts = rows.groupBy(F.col(PART).cast("long").alias(PART)).agg(F.count(F.lit(1)).alias("__n__"))
    offsets = sums_before(counts, PART, ["__n__"], last_part)
    rows = rows.withColumn(PART, F.col(PART).cast("long")).join(F.broadcast(offsets), PART)
    return _put_index(rows, F.col("__n__") + F.col(POS), index).drop(PART, POS, "__n__")


def running_sums(
    table: DataFrame, groups: Sequence[str], order: Sequence[str], values: dict[str, Column | str],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Sums over the earlier rows of the same group; ``groups`` + ``order`` must be unique and not null.

    A group of any size is spread over range partitions. Each (partition, group) is summed by a window, and one
    total per (partition, group) is carried forward. Output: the input columns and one column per value; ``totals``
    adds the whole group's sum of a value under another name, ``{name: value}``.
    """
    groups, order = list(groups), list(order)
    source = {k: v if isinstance(v, str) else f"__v__{k}" for k, v in values.items()}
    computed = {f"__v__{k}": v for k, v in values.items() if not isinstance(v, str)}
    rows = table.withColumns(computed) if computed else table
    rows = sorted_parts(rows, [*groups, *order], fineness=4).drop(POS)
    inside = Window.partitionBy(PART, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(groups or [F.lit(0)]))  # one row per partition that the group touches
    carried = rows.groupBy(PART, *groups).agg(*[F.sum(v).alias(f"__t__{k}") for k, v in source.items()]).select(
        PART, *groups, *[F.coalesce(F.sum(f"__t__{k}").over(across), F.lit(0)).alias(f"__c__{k}") for k in values],
        *[F.sum(f"__t__{k}").over(whole).alias(name) for name, k in (totals or {}).items()],
    )
    inner = rows.withColumns(
        {f"__i__{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in source.items()}
    )
    return inner.join(carried, [PART, *groups]).select(
        *[ref(c) for c in table.columns], *[(F.col(f"__i__{k}") + F.col(f"__c__{k}")).alias(k) for k in values],
        *(totals or {}),
    )
