"""Sorting, top rows and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidParameter
from ..plans.columns import FLOATING, INDEX, data_columns, nullify_nan, ref, require, type_of
from ..plans.joins import bounded, lookup_join
from ..plans.order import with_row_index
from ..plans.store import keep as keep_table


def sort_keys(df: DataFrame, columns: Sequence[str | tuple[str, bool]], index: str = INDEX) -> list[Column]:
    """Nulls come last in both directions; the row index, when there is one, breaks ties."""
    keys = []
    for spec in columns:
        if isinstance(spec, str):
            name, ascending = spec, True
        elif isinstance(spec, dict):
            name, ascending = spec["column"], spec.get("ascending", True)
        else:
            name, ascending = spec
        c = ref(*require(df, [name]))
        keys.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    if index in df.columns:
        keys.append(ref(index).asc())
    return keys


def sort_data(
    df: DataFrame, columns: Sequence[str | tuple[str, bool]], index: str = INDEX, renumbered: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Sort; ``renumbered`` gives the rows new positions (needs the old index, which makes the order unique).

    With ``limit`` only that many rows are kept, and Spark plans a top-k without a full sort.
    """
    df = nullify_nan(df)
    keys = sort_keys(df, columns, index)
    if limit is not None:
        return df.orderBy(*keys).limit(limit)
    if renumbered:
        require(df, [index])
        return with_row_index(df, keys, index)
    return df.orderBy(*keys)


# Repeated key hashes up to this many are broadcast themselves; of more, a bitmap of 2**MAP_BITS bits is.
REPEATED_HASHES = 1_000_000
MAP_BITS = 26
_HASH = ("__h1__", "__h2__")


def _hashed(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """A row's 128-bit key hash. Where nulls stand is part of it, since hashing passes over them; -0.0 is 0.0."""
    values = [ref(k) + F.lit(0.0) if isinstance(type_of(df, k), FLOATING) else ref(k) for k in keys]
    holes = F.concat(*[F.when(ref(k).isNull(), "1").otherwise("0") for k in keys]) if keys else F.lit("")
    return [F.xxhash64(holes, *values).alias(_HASH[0]), F.xxhash64(F.lit(1), *values, holes).alias(_HASH[1])]


def _marked(rows: DataFrame, repeated: DataFrame, broadcast_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with the columns of ``repeated`` for their hash, null where the hash is unique; and rows known to be unique, if kept apart.

    Only rows whose bit is set in a map of the repeated hashes are shuffled: those with twins, and one in a few of the others.
    """
    small = bounded(repeated, broadcast_rows)
    if small is not repeated:
        return rows.join(small, list(_HASH), "left"), None
    place = lambda: F.shiftrightunsigned(F.col(_HASH[0]), 64 - MAP_BITS)
    bits = repeated.groupBy(F.bitmap_bucket_number(place()).alias("__bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place())).alias("__bits__"))
    held = rows.withColumn("__bucket__", F.bitmap_bucket_number(place())).withColumn("__slot__", F.bitmap_bit_position(place()))
    held = held.join(F.broadcast(bits), "__bucket__", "left")  # 2**MAP_BITS / 8 bytes at most
    byte = F.conv(F.hex(F.substring("__bits__", F.floor(F.col("__slot__") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__slot__ % 8 as int))")) != 0, F.lit(False))
    held = held.withColumn("__maybe__", maybe)
    twins = held.filter("__maybe__").select(*[ref(c) for c in rows.columns])
    single = held.filter("NOT __maybe__").select(*[ref(c) for c in rows.columns])
    return lookup_join(twins, repeated, list(_HASH), "__n__", "left"), single


def remove_duplicates(
    df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", index: str = INDEX,
    broadcast_rows: int = REPEATED_HASHES,
) -> DataFrame:
    """Keep the first or last row (in index order) of every group of equal rows, or none of a group with twins.

    Null equals null. Only 128-bit key hashes and the index are shuffled to find the hashes that occur more than once; a key that holds a third
    of the table moves one row per task. Rows whose hash is unique pass on without a shuffle, others are compared with the row chosen for
    their hash. The survivors keep their index; ``renumber`` closes the gaps.
    """
    if keep not in ("first", "last", "none"):
        raise InvalidParameter("keep", keep, "first, last or none")
    df = nullify_nan(df)
    keys = data_columns(df, subset, index)
    indexed = index in df.columns
    if not indexed and keep != "none" and set(df.columns) - set(keys):
        raise InvalidParameter("index", index, "a row order, as the rows of a group differ outside the subset")
    chosen = (F.max if keep == "last" else F.min)(ref(index)) if indexed else F.lit(None).cast("long")
    hashes = df.select(*_hashed(df, keys), *([ref(index)] if indexed else []))
    groups = hashes.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("__n__"), chosen.alias("__chosen__"))
    repeated = keep_table(groups.filter("__n__ > 1"))
    rows = df.select(*[ref(c) for c in df.columns], *_hashed(df, keys))
    marked, single = _marked(rows, repeated, broadcast_rows)
    columns = [ref(c) for c in df.columns]
    if keep == "none":
        out = marked.filter("__n__ IS NULL").select(*columns)
    elif indexed:
        out = marked.filter(F.col("__n__").isNull() | (ref(index) == F.col("__chosen__"))).select(*columns)
    else:  # twins are alike in every column: one of them is made from the group
        twins = marked.filter("__n__ IS NOT NULL").select(*columns)
        twins = twins.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n__")).select(*columns)
        out = marked.filter("__n__ IS NULL").select(*columns).unionByName(twins)
    return out if single is None else out.unionByName(single.select(*columns))


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None, index: str = INDEX) -> DataFrame:
    """total rows and duplicates (rows after the first of their group), from the 128-bit hashes of the keys."""
    df = nullify_nan(df)
    groups = df.select(*_hashed(df, data_columns(df, subset, index))).groupBy(*_HASH).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )
