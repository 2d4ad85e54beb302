"""Equi-joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A key is hot when it holds at least this share of the rows, or half of what a shuffle partition gets on the average
# if that is less. So there are at most 1/share hot keys, or two for each partition.
HOT_SHARE = 1 / 1000
_COPIES, _SALT, _KEY = "__copies__", "__salt__", "__key__"
# With a bound on the rows of a task, this many salts for each partition's worth of a hot key: hashing spreads many small heaps evenly.
_HEAPS = 8


# A side of at most this many rows and bytes, counted beforehand, is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def _bytes(df: DataFrame) -> Column:
    """About how much a row holds: texts by their length, nested values by that of their JSON, others 16 bytes."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        size = size + 16
    return size


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a join side for broadcast when its rows and bytes are counted to be few; the count stops at the bound."""
    counted = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(_bytes(df)).alias("bytes")).first()
    return F.broadcast(df) if counted["rows"] <= rows and (counted["bytes"] or 0) <= size else df


def partitions_for(df: DataFrame, rows: int, task_rows: int) -> int:
    """As many partitions as shuffles have, or more if ``rows`` of them are more than ``task_rows`` for each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))


def lookup_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], weight: str, how: str = "inner", task_rows: int | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` (unique on ``on``), where ``weight`` counts the rows of ``big`` per key.

    A hot key gets as many salts as its share of the shuffle partitions; its rows in ``big`` are spread over them and
    its row in ``small`` is copied to each, so all copies together stay below three times the partitions + 1/HOT_SHARE. Other keys
    keep salt 0. The hot keys reach ``big`` by a broadcast join, bounded by 1/HOT_SHARE rows or two for each partition.
    Rows of ``big`` must differ (aggregate them, or carry the row index): the salt is a hash of the row, so that a
    task that runs twice gives the same result. ``how`` is ``inner`` or ``left_semi``; keys must not be null.

    ``task_rows`` bounds the rows of ``big`` that a task sorts, to about this many: both sides are dealt to a number of
    partitions that follows from the rows, which Spark doesn't merge again by their compressed bytes. A small ``small`` is broadcast.
    """
    on = list(on)
    counted = small.agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("keys")).first()
    if task_rows and counted["keys"] <= BROADCAST_ROWS:
        return big.join(bounded(small), on, how)
    total = float(counted["total"] or 0)
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = partitions_for(big, int(total), task_rows) if task_rows else partitions
    partitions = parts * _HEAPS if task_rows else partitions
    hot = F.col(weight) >= F.lit(total * min(HOT_SHARE, 0.5 / partitions))
    copies = F.greatest(F.lit(1), F.ceil(F.col(weight) * F.lit(partitions) / F.lit(total or 1.0))).cast("int")
    hot_keys = small.filter(hot).select(*on, copies.alias(_COPIES))
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns])
    left = (
        big.join(F.broadcast(hot_keys), on, "left")
        .withColumn(_SALT, F.coalesce(F.pmod(row_hash, F.col(_COPIES)).cast("int"), F.lit(0))).drop(_COPIES)
    )
    right = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.when(hot, copies - 1).otherwise(F.lit(0)))))
    if not task_rows:
        return left.join(right, [*on, _SALT], how).drop(_SALT)
    # Spark would shuffle doubles again to join them, so both sides meet by a hash; the bounds keep only what is equal.
    left, right = (x.withColumn(_KEY, F.xxhash64(*[F.col(f"`{c}`") for c in on])).repartition(parts, _KEY, _SALT) for x in (left, right))
    right = right.withColumnsRenamed({c: f"__of__{c}" for c in [*on, _KEY, _SALT]}).hint("merge")
    same = (F.col(_KEY) == F.col(f"__of__{_KEY}")) & (F.col(_SALT) == F.col(f"__of__{_SALT}"))
    for c in on:
        same = same & F.col(f"`{c}`").between(F.col(f"`__of__{c}`"), F.col(f"`__of__{c}`"))
    return left.join(right, same, how).drop(_KEY, _SALT, *[f"__of__{c}" for c in [*on, _KEY, _SALT]])
