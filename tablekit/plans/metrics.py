"""Metrics of many columns from one scan."""

from __future__ import annotations

import operator as op
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import FLOATING, INTEGRAL, as_double, combined, missing, type_of, value_of
from .joins import bounded

COLUMNS_PER_SLICE = 50   # keeps the generated code of one aggregate small on wide tables


def value_slots(df: DataFrame, name: str) -> list[Column]:
    """A value as (long, double, text): equality and order are those of the column's own type.

    One of them is set, or both double and text for decimals: the first orders them, the second is exact.
    """
    c, dtype = value_of(df, name), type_of(df, name)
    slots = {"l": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}
    if isinstance(dtype, INTEGRAL):
        slots["l"] = c.cast("long")
    elif isinstance(dtype, FLOATING):
        slots["d"] = c.cast("double") + F.lit(0.0)
    elif isinstance(dtype, T.DecimalType):
        slots["d"], slots["s"] = c.cast("double"), c.cast("string")
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        slots["s"] = F.when(c.isNotNull(), F.to_json(c))
    elif isinstance(dtype, T.BinaryType):
        slots["s"] = F.hex(c)
    else:
        slots["s"] = c.cast("string")
    return [v.alias(k) for k, v in slots.items()]


#: Bytes of a text that take part in its order inside a histogram.
PREFIX = 24


def text_key(text: Column) -> list[Column]:
    """A text's 128-bit hash, null for null."""
    known = lambda h: F.when(text.isNotNull(), h)
    return [known(F.xxhash64(text)).alias("h1"), known(F.xxhash64(F.lit(1), text)).alias("h2")]


def value_histogram(df: DataFrame, columns: Sequence[str], ordered: bool = False) -> DataFrame:
    """(column number c, value slots l / d, hash of the text slot h1 / h2, count n) for all columns from one scan.

    Texts are counted by their hashes, so that none is shuffled. ``ordered`` adds ``p``, their first bytes, and ``whole``, whether that is
    all. Counts are combined before the shuffle, so a value that fills a third of the rows costs one row per task.
    """
    def cell(i, name):
        l, d, s = value_slots(df, name)
        text = F.substring(s.cast("binary"), 1, PREFIX).alias("p"), (F.octet_length(s) <= PREFIX).alias("whole")
        return F.struct(F.lit(i).alias("c"), l, d, *text_key(s), *(text if ordered else ()))

    rows = df.select(F.explode(F.array(*[cell(i, name) for i, name in enumerate(columns)])).alias("x")).select("x.*")
    more = [F.min("p").alias("p"), F.bool_and("whole").alias("whole")] if ordered else []
    return rows.groupBy("c", "l", "d", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), *more)


def is_null_slot() -> Column:
    return F.col("l").isNull() & F.col("d").isNull() & F.col("h1").isNull()


def texts_of(df: DataFrame, columns: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (c, h1, h2) with the text ``s`` of each hash, from one scan. A few of them are broadcast, so that the texts aren't shuffled."""
    numbers = [r["c"] for r in wanted.select("c").distinct().collect()]
    if not numbers:
        return wanted.select("c", "h1", "h2", F.lit(None).cast("string").alias("s"))

    def cell(i):
        s = value_slots(df, columns[i])[2]
        return F.struct(F.lit(i).alias("c"), *text_key(s), s)

    cells = df.select(F.explode(F.array(*[cell(i) for i in numbers])).alias("x")).select("x.*")
    return cells.join(bounded(wanted), ["c", "h1", "h2"]).groupBy("c", "h1", "h2").agg(F.min("s").alias("s"))


def column_tops(df: DataFrame, columns: Sequence[str], nulls: bool = True) -> dict[int, dict]:
    """By column number: rows, nulls, distinct values (``uniques``), and the most frequent value's slots ``l``, ``d``, ``s`` and count ``n``.

    Ties go to the smallest value, null last; without ``nulls`` null is no value. Only a row per column reaches the driver. Texts longer than
    ``PREFIX`` bytes are found by another scan.
    """
    hist = value_histogram(df, columns, ordered=True)
    if not nulls:
        hist = hist.filter(~is_null_slot())
    best = F.min_by(F.struct("l", "d", "h1", "p", "whole", "n", F.col("l").cast("string").alias("l_text"), F.col("d").cast("string").alias("d_text")), F.struct(-F.col("n"), is_null_slot(), F.col("l"), F.col("d"), F.col("p")))
    rows = hist.groupBy("c").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(is_null_slot(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(~is_null_slot()).alias("uniques"), best.alias("top"),
    ).collect()
    out = {r["c"]: {"rows": r["rows"], "nulls": r["nulls"], "uniques": r["uniques"], **r["top"].asDict()} for r in rows}
    for x in out.values():
        x["s"] = bytes(x["p"]).decode(errors="replace") if x["p"] is not None and x["whole"] else None
    long = {c: x for c, x in out.items() if x["p"] is not None and not x["whole"]}
    once = {c: x for c, x in long.items() if x["n"] == 1}
    if once:  # every value is among the most frequent ones
        row = df.agg(*[F.min(value_slots(df, columns[c])[2]).alias(f"m{c}") for c in once]).first()
        for c in once:
            out[c]["s"] = row[f"m{c}"]
    if more := {c: x for c, x in long.items() if x["n"] > 1}:
        tied = combined(op.or_, [(F.col("c") == c) & (F.col("n") == x["n"]) & (F.col("p") == F.lit(bytes(x["p"]))) for c, x in more.items()])
        found = texts_of(df, columns, hist.filter(tied).select("c", "h1", "h2"))
        for r in found.groupBy("c").agg(F.min("s").alias("s")).collect():
            out[r["c"]]["s"] = r["s"]
    return out


#: Of a column without values.
NO_TOP = {"n": None, "l_text": None, "d_text": None, "s": None}


def slot_text(top: dict | None) -> str | None:
    """A value's slots as text, decimals exactly."""
    return None if top is None else next((x for x in (top["l_text"], top["s"], top["d_text"]) if x is not None), None)


def column_names(columns: Sequence[str]) -> Column:
    """The name for a column number ``c``."""
    return F.element_at(F.array(*[F.lit(name) for name in columns]), F.col("c") + 1)


def per_column(df: DataFrame, columns: Sequence[str], metrics) -> DataFrame:
    """One row per column: ``metrics(name) -> {metric: aggregate Column}``, all from one aggregate per slice."""
    out = None
    for at in range(0, len(columns), COLUMNS_PER_SLICE):
        part = list(columns[at : at + COLUMNS_PER_SLICE])
        per = {name: metrics(name) for name in part}
        row = df.agg(*[
            F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in per[name].items()]).alias(f"m{i}")
            for i, name in enumerate(part)
        ])
        rows = row.select(F.explode(F.array(*[F.col(f"m{i}") for i in range(len(part))])).alias("m")).select("m.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def sliced_row(df: DataFrame, metrics: Sequence[Column]) -> dict:
    """One row of named aggregates on the driver, computed in slices."""
    out: dict = {}
    for at in range(0, len(metrics), COLUMNS_PER_SLICE):
        out |= df.agg(*metrics[at : at + COLUMNS_PER_SLICE]).first().asDict()
    return out


def null_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """(rows, nulls per column) on the driver, from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, c)).alias(f"c{i}")
                                                 for i, c in enumerate(columns)]).first()
    return row["n"], {c: row[f"c{i}"] for i, c in enumerate(columns)}


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Count, mean and sample deviation per column on the driver, from one aggregate."""
    if not columns:
        return {}
    row = df.agg(*[
        F.struct(F.count(as_double(df, c)).alias("count"), F.avg(as_double(df, c)).alias("mean"),
                 F.coalesce(F.stddev_samp(as_double(df, c)), F.lit(0.0)).alias("std")).alias(f"m{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: row[f"m{i}"].asDict() for i, c in enumerate(columns)}

