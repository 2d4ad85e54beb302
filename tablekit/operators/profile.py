"""Profiles, summaries and table checks."""

from __future__ import annotations

import operator as op
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.columns import (
    INDEX, boolean_columns, combined, data_columns, datetime_columns, missing, numeric_columns, ref, text_columns, type_label,
    type_of, value_of,
)
from ..plans.metrics import NO_TOP, column_tops, is_null_slot, per_column, slot_text, sliced_row, value_histogram, value_slots
from ..settings import DEFAULTS, Thresholds


def _percent(part, whole):
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def _labels(df, names):
    return df.sparkSession.createDataFrame(
        [(i, c, type_label(type_of(df, c))) for i, c in enumerate(names)], "c int, column string, data_type string"
    )


_NOTHING = {"rows": 0, "nulls": 0, "uniques": 0, **NO_TOP}
#: Items that a sketch of frequent values tracks.
SKETCHED = 10_000


def _sketched_tops(df, names):
    """As ``column_tops``, from sketches. The frequent ones are hashes, so that no sketch holds texts; another scan reads the values."""
    key = {c: F.xxhash64(*value_slots(df, c)) for c in names}
    metrics = [
        F.struct(
            F.count(F.lit(1)).alias("rows"), F.count_if(missing(df, c)).alias("nulls"), F.approx_count_distinct(value_of(df, c)).alias("uniques"),
            F.call_function("approx_top_k", key[c], F.lit(1), F.lit(SKETCHED)).alias("top"),
        ).alias(f"m{i}") for i, c in enumerate(names)
    ]
    row = sliced_row(df, metrics)
    tops = {i: row[f"m{i}"]["top"][0] for i in range(len(names)) if row[f"m{i}"]["top"]}
    texts = {"l_text": lambda s: s[0].cast("string"), "s": lambda s: s[2], "d_text": lambda s: s[1].cast("string")}
    reads = [
        F.struct(*[F.min(F.when(key[names[i]] == t["item"], read(value_slots(df, names[i])))).alias(k) for k, read in texts.items()]).alias(f"m{i}")
        for i, t in tops.items()
    ]
    values = sliced_row(df, reads)
    return {
        i: {**row[f"m{i}"].asDict(), "n": tops[i]["count"], **values[f"m{i}"].asDict()} if i in tops else {**_NOTHING, **row[f"m{i}"].asDict()}
        for i in range(len(names))
    }


def profile_data(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, index: str = INDEX) -> DataFrame:
    """Per column: type, nulls, distinct values, and the most frequent value (null included) with its frequency.

    Exact: one histogram over all columns, whose shuffle carries each distinct number, or hash of a text, once per task. ``exact=False``:
    one scan with a distinct-count sketch and a sketch of frequent hashes, no shuffle of values; a frequency is then an estimate, at most
    rows / ``SKETCHED`` too high or too low, and the value is the most frequent one up to that error.
    """
    names = data_columns(df, columns, index)
    spark = df.sparkSession
    found = column_tops(df, names) if exact and names else {}
    if not exact:
        found = _sketched_tops(df, names)
    stats = spark.createDataFrame(
        [(i, c, type_label(type_of(df, c)), x["rows"], x["nulls"], x["uniques"], slot_text(x), x["n"])
         for i, c in enumerate(names) for x in [found.get(i, _NOTHING)]],
        "c int, column string, data_type string, rows long, nulls long, uniques long, top string, top_n long",
    )
    top, frequency = F.col("top"), F.col("top_n")
    rows, nulls, uniques = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("rows", "nulls", "uniques"))
    return stats.select(
        "column", "data_type", nulls.alias("null_count"), _percent(nulls, rows).alias("null_percentage"),
        uniques.alias("unique_count"), _percent(uniques, rows).alias("unique_percentage"),
        top.alias("most_frequent"), frequency.alias("frequency"),
    )


def get_data_summary(df: DataFrame, exact: bool = True, index: str = INDEX) -> DataFrame:
    """Per column: type, kind, whether it holds nulls, distinct and null counts."""
    names = data_columns(df, None, index)
    kinds = {c: kind for kind, of_kind in (
        ("numeric", numeric_columns), ("text", text_columns), ("datetime", datetime_columns),
        ("boolean", boolean_columns),
    ) for c in of_kind(df, None, index)}
    kind = F.element_at(F.array(*[F.lit(kinds.get(c, "other")) for c in names]), F.col("c") + 1)
    labels = _labels(df, names).withColumn("kind", kind).drop("c")
    return profile_data(df, None, exact, index).join(labels.select("column", "kind"), "column").select(
        "column", F.col("data_type").alias("type"), "kind", (F.col("null_count") > 0).alias("nullable"),
        "unique_count", "null_count",
    )


def get_table_summary(df: DataFrame, index: str = INDEX) -> DataFrame:
    """One row: shape, missing cells, and how many columns of each kind there are."""
    names = data_columns(df, None, index)
    holes = combined(op.add, [F.lit(0).cast("long"), *[F.count_if(missing(df, c)) for c in names]])
    cells = F.col("rows") * F.lit(len(names))
    return df.agg(F.count(F.lit(1)).alias("rows"), holes.alias("total_missing")).select(
        "rows", F.lit(len(names)).cast("long").alias("columns"), "total_missing",
        _percent(F.col("total_missing"), cells).alias("missing_percentage"),
        *[F.lit(len(of_kind(df, None, index))).cast("long").alias(f"{kind}_columns") for kind, of_kind in (
            ("numeric", numeric_columns), ("text", text_columns), ("datetime", datetime_columns),
            ("boolean", boolean_columns),
        )],
    )


# The forms a text value is recognised by, tried in this order.
VALUE_FORMS = (
    ("boolean", r"^(?i:true|false)$"),
    ("integer", r"^[+-]?\d+$"),
    ("float", r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"),
    ("date", r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}.*)?$"),
)


def value_form(c):
    """What a text value looks like: boolean, integer, float, date or text; null for null."""
    c = F.trim(c)
    form = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, pattern in VALUE_FORMS:
        form = form.when(c.rlike(pattern), F.lit(name))
    return form.otherwise(F.lit("text"))


def value_forms(df: DataFrame, columns: Sequence[str] | None = None, index: str = INDEX) -> DataFrame:
    """Per text column: how many values look like each form, from one scan."""
    names = text_columns(df, columns, index)
    forms = [name for name, _ in VALUE_FORMS] + ["text"]
    return per_column(
        df.select(*[value_form(ref(c)).alias(c) for c in names]), names,
        lambda c: {f"{form}_values": F.count_if(ref(c) == form) for form in forms},
    )


def validate_dataframe(df: DataFrame, index: str = INDEX, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """(severity, issue, column) of common problems.

    Empty table; repeated column names; columns without any value; text columns whose values take several forms; text
    columns with mostly distinct values; text columns whose values all parse as dates.
    """
    schema = "severity string, issue string, column string"
    spark = df.sparkSession
    repeated = sorted(c for c, n in Counter(df.columns).items() if n > 1)
    if repeated:
        return spark.createDataFrame([("error", "duplicate_column_name", c) for c in repeated], schema)
    names = data_columns(df, None, index)
    text = text_columns(df, None, index)
    seen = {c: F.collect_set(value_form(ref(c))) for c in text}  # at most five forms
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(missing(df, c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[v.alias(f"f{i}") for i, v in enumerate(seen.values())],
        *[F.bool_and(ref(c).try_cast("timestamp_ntz").isNotNull() | ref(c).isNull()).alias(f"d{i}") for i, c in enumerate(text)],
    ).first()
    if row["rows"] == 0:
        return spark.createDataFrame([("error", "empty_table", None)], schema)
    found = [("warning", "all_null", c) for i, c in enumerate(names) if row[f"n{i}"] == row["rows"]]
    found += [("warning", "mixed_forms", c) for i, c in enumerate(text) if len(row[f"f{i}"]) > 1]
    if text:
        uniques = value_histogram(df, text).groupBy("c").agg(F.count_if(~is_null_slot()).alias("u")).collect()
        found += [("info", "high_cardinality", text[r["c"]]) for r in uniques
                  if r["u"] / row["rows"] > thresholds.numeric_text_share]
    found += [("info", "potential_datetime", c) for i, c in enumerate(text)
              if row[f"d{i}"] and row[f"n{names.index(c)}"] < row["rows"]]
    return spark.createDataFrame(found, schema)
