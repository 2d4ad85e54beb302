"""Schema validation: rules per column, one scan for all row checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidParameter
from ..functions.text import check_regex
from ..plans.columns import INDEX, NUMERIC, equals, is_one_of, missing, require, type_of, value_of
from ..plans.joins import lookup_join
from ..plans.store import keep


@dataclass(frozen=True)
class ColumnRules:
    """What the values of a column must satisfy. A null passes every check but ``nullable`` while ``ignore_na``."""

    nullable: bool = True
    unique: bool = False
    equal_to: Any = None
    not_equal_to: Any = None
    greater_than: float | None = None
    greater_than_or_equal_to: float | None = None
    less_than: float | None = None
    less_than_or_equal_to: float | None = None
    in_range: Mapping[str, float] | None = None
    isin: Sequence | None = None
    notin: Sequence | None = None
    str_contains: str | None = None
    str_endswith: str | None = None
    str_startswith: str | None = None
    str_matches: str | None = None
    str_length: Mapping[str, int] | None = None
    ignore_na: bool = True

    def __post_init__(self):
        for name in ("in_range", "str_length"):
            limits = getattr(self, name)
            if limits is not None and (not limits or set(limits) - {"min", "max"}):
                raise InvalidParameter(name, limits, "a dictionary with 'min' and / or 'max'")


Schema = Mapping[str, ColumnRules | Mapping[str, Any]]
_NUMBER_RULES = ("greater_than", "greater_than_or_equal_to", "less_than", "less_than_or_equal_to", "in_range")


def _rules(rules: ColumnRules | Mapping[str, Any]) -> ColumnRules:
    if isinstance(rules, ColumnRules):
        return rules
    known = {f.name for f in fields(ColumnRules)}
    for name in rules:
        if name not in known:
            raise InvalidParameter("rule", name, f"one of {sorted(known)}")
    return ColumnRules(**rules)


def _outside(c: Column, limits: Mapping[str, float]) -> Column:
    bad = F.lit(False)
    if limits.get("min") is not None:
        bad = bad | (c < F.lit(limits["min"]))
    if limits.get("max") is not None:
        bad = bad | (c > F.lit(limits["max"]))
    return bad


def row_checks(df: DataFrame, column: str, rules: ColumnRules | Mapping[str, Any]) -> dict[str, Column]:
    """Per check of one column: whether a row violates it (true or false, never null)."""
    r, c = _rules(rules), value_of(df, column)
    if not isinstance(type_of(df, column), NUMERIC):
        for name in _NUMBER_RULES:
            limit = getattr(r, name)
            parts = limit.values() if isinstance(limit, Mapping) else [limit]
            if any(isinstance(x, (int, float)) for x in parts):
                raise InvalidParameter(name, column, "a numeric column")
    text = c.cast("string")
    spark = df.sparkSession

    def same(v):
        hit = equals(df, column, v)
        return F.lit(False) if hit is None else hit

    violated = {
        "equal_to": lambda v: ~same(v),
        "not_equal_to": lambda v: same(v),
        "greater_than": lambda v: c <= F.lit(v),
        "greater_than_or_equal_to": lambda v: c < F.lit(v),
        "less_than": lambda v: c >= F.lit(v),
        "less_than_or_equal_to": lambda v: c > F.lit(v),
        "in_range": lambda v: _outside(c, v),
        "isin": lambda v: ~is_one_of(df, column, v),
        "notin": lambda v: is_one_of(df, column, v),
        "str_contains": lambda v: ~text.rlike(check_regex(spark, v)),
        "str_endswith": lambda v: ~text.endswith(v),
        "str_startswith": lambda v: ~text.startswith(v),
        "str_matches": lambda v: ~text.rlike(f"^(?:{check_regex(spark, v)})"),
        "str_length": lambda v: _outside(F.char_length(text), v),
    }
    checks = {}
    if not r.nullable:
        checks["not_nullable"] = missing(df, column)
    for name, test in violated.items():
        value = getattr(r, name)
        if value is not None:
            hit = F.when(c.isNotNull(), test(value))
            checks[name] = F.coalesce(hit, F.lit(not r.ignore_na))
    return checks


def _present(df: DataFrame, schema: Schema) -> dict[str, ColumnRules]:
    return {c: _rules(r) for c, r in schema.items() if c in df.columns}


def _repeated(df: DataFrame, column: str) -> DataFrame:
    """(value, rows) of the values that occur more than once; null is not a value."""
    return (
        df.select(value_of(df, column).alias("__v__")).filter("__v__ IS NOT NULL")
        .groupBy("__v__").agg(F.count(F.lit(1)).alias("__n__")).filter("__n__ > 1")
    )


def schema_violations(
    df: DataFrame, schema: Schema, max_errors: int | None = None, index: str = INDEX
) -> DataFrame:
    """(column, check_name, row index, failure_case) of every violation.

    One scan evaluates all row checks. A ``unique`` rule adds an aggregate and a join on the repeated values only,
    balanced for hot values. A schema column that the table lacks gives one ``column_missing`` row. ``max_errors`` keeps the
    first violations by column, check and row.
    """
    require(df, [index])
    present = _present(df, schema)
    spark = df.sparkSession
    out = spark.createDataFrame(
        [(c, "column_missing") for c in schema if c not in df.columns], "column string, check_name string"
    ).select("column", "check_name", F.lit(None).cast("long").alias(index), F.lit(None).cast("string").alias("failure_case"))
    cells = [
        F.when(hit, F.struct(
            F.lit(c).alias("column"), F.lit(name).alias("check_name"),
            value_of(df, c).cast("string").alias("failure_case"),
        )) for c, rules in present.items() for name, hit in row_checks(df, c, rules).items()
    ]
    if cells:
        found = F.filter(F.array(*cells), lambda x: x.isNotNull())
        rows = df.select(F.col(index).cast("long").alias(index), F.explode(found).alias("x"))
        out = out.unionByName(rows.select("x.column", "x.check_name", index, "x.failure_case"))
    for c, rules in present.items():
        if rules.unique:
            rows = df.select(F.col(index).cast("long").alias(index), value_of(df, c).alias("__v__"))
            twins = lookup_join(rows.filter("__v__ IS NOT NULL"), keep(_repeated(df, c)), ["__v__"], "__n__")
            out = out.unionByName(twins.select(
                F.lit(c).alias("column"), F.lit("unique").alias("check_name"), index,
                F.col("__v__").cast("string").alias("failure_case"),
            ))
    return out.orderBy("column", "check_name", index, "failure_case").limit(max_errors) if max_errors else out


def schema_checks(df: DataFrame, schema: Schema, index: str = INDEX) -> DataFrame:
    """(column, check_name, violations): every check with its count, from one aggregate and one per ``unique`` rule."""
    present = _present(df, schema)
    checks = [(c, name, hit) for c, rules in present.items() for name, hit in row_checks(df, c, rules).items()]
    counts = {}
    if checks:
        row = df.agg(*[F.count_if(hit).alias(f"k{i}") for i, (_, _, hit) in enumerate(checks)]).first()
        counts.update({(c, name): row[f"k{i}"] for i, (c, name, _) in enumerate(checks)})
    for c, rules in present.items():
        if rules.unique:
            counts[c, "unique"] = _repeated(df, c).agg(F.coalesce(F.sum("__n__"), F.lit(0))).first()[0]
    counts.update({(c, "column_missing"): 1 for c in schema if c not in df.columns})
    return df.sparkSession.createDataFrame(
        [(c, name, n) for (c, name), n in counts.items()], "column string, check_name string, violations bigint"
    )


def schema_summary(df: DataFrame, schema: Schema, index: str = INDEX) -> DataFrame:
    """One row: valid, total / valid / invalid columns, missing and extra columns, number of violations."""
    counted = schema_checks(df, schema, index).collect()  # one row per check
    failed = {r["column"] for r in counted if r["violations"] > 0}
    lacking = sorted(c for c in schema if c not in df.columns)
    extra = sorted(c for c in df.columns if c not in schema and c != index)
    return df.sparkSession.createDataFrame(
        [(not failed, len(schema), len(schema) - len(failed), len(failed), ",".join(lacking), ",".join(extra),
          sum(r["violations"] for r in counted))],
        "valid boolean, total_columns bigint, valid_columns bigint, invalid_columns bigint, missing_columns string, "
        "extra_columns string, violations bigint",
    )
