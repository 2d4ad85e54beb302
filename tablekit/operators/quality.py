"""Quality score: rules over the whole table, each with a score from 0 to 100."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..plans.columns import (
    DATETIME, INDEX, beyond, data_columns, datetime_columns, missing, numeric_columns, ref, text_columns, type_of,
)
from ..plans.metrics import COLUMNS_PER_SLICE, is_null_slot, value_histogram
from ..plans.quantiles import quantiles, scaled_bounds
from ..settings import DEFAULTS, Thresholds
from .arrange import duplicate_count
from .profile import value_form


@dataclass(frozen=True)
class Completeness:
    threshold: float = 0.95
    columns: Sequence[str] | None = None


@dataclass(frozen=True)
class Duplicates:
    threshold: float = 0.01
    columns: Sequence[str] | None = None


@dataclass(frozen=True)
class Uniqueness:
    column: str
    expected_unique: bool = True


@dataclass(frozen=True)
class DataTypes:
    """A Spark column holds one type. With ``by_form`` a text column fails, with 50, if its values take several forms."""

    by_form: bool = False


@dataclass(frozen=True)
class Outliers:
    threshold: float = 0.05


@dataclass(frozen=True)
class Consistency:
    columns: Sequence[str] = ()


Rule = Completeness | Duplicates | Uniqueness | DataTypes | Outliers | Consistency
DEFAULT_RULES: tuple[Rule, ...] = (Completeness(), Duplicates(), DataTypes(), Outliers(), Consistency())

# What a number stored as text looks like.
NUMERIC_TEXT = r"^-?\d+\.?\d*$"
OUTLIER_FACTOR = 1.5

_RESULT = "rule_type string, column string, passed boolean, score double, affected_rows bigint, metric_value double, " \
          "threshold double, severity string, recommendation string"


@dataclass(frozen=True)
class QualityReport:
    """``rules``: one row per rule and column, failed ones with their issue. ``overall``: one row."""

    rules: DataFrame
    overall: DataFrame


def _date_pair(df: DataFrame, rule: Consistency, index: str) -> tuple[str, str] | None:
    names = list(rule.columns) or datetime_columns(df, None, index)
    if len(names) < 2 or any(c not in df.columns or not isinstance(type_of(df, c), DATETIME) for c in names[:2]):
        return None
    return names[0], names[1]


def _facts(df: DataFrame, rules: Sequence[Rule], index: str) -> dict:
    """Every count that the rules need: one fused aggregate (sliced for wide tables) after the quartiles."""
    names, numeric = data_columns(df, None, index), numeric_columns(df, None, index)
    wanted = {("rows",): F.count(F.lit(1))}
    for rule in rules:
        if isinstance(rule, Completeness):
            wanted |= {("nulls", c): F.count_if(missing(df, c)) for c in rule.columns or names if c in df.columns}
        elif isinstance(rule, DataTypes):
            wanted |= {("nulls", c): F.count_if(missing(df, c)) for c in names}
            wanted |= {("numeric_text", c): F.count_if(ref(c).rlike(NUMERIC_TEXT)) for c in text_columns(df, None, index)}
            if rule.by_form:  # at most five forms
                wanted |= {("forms", c): F.size(F.collect_set(value_form(ref(c)))) for c in text_columns(df, None, index)}
        elif isinstance(rule, Outliers):
            for c, q in quantiles(df, numeric, (0.25, 0.75)).items():
                bounds = scaled_bounds(q, OUTLIER_FACTOR)
                outside = beyond(df, c, *bounds[:2])[1] if bounds else F.lit(False)
                wanted["outliers", c] = F.count_if(outside)
        elif isinstance(rule, Consistency) and _date_pair(df, rule, index):
            a, b = _date_pair(df, rule, index)
            wanted["inconsistent", a, b] = F.count_if(ref(a) > ref(b))
    facts, keys = {}, list(wanted)
    for at in range(0, len(keys), 4 * COLUMNS_PER_SLICE):
        part = keys[at : at + 4 * COLUMNS_PER_SLICE]
        row = df.agg(*[wanted[k].alias(f"f{i}") for i, k in enumerate(part)]).first()
        facts |= {k: row[f"f{i}"] for i, k in enumerate(part)}
    unique = list(dict.fromkeys(r.column for r in rules if isinstance(r, Uniqueness) and r.column in df.columns))
    if unique:
        counted = value_histogram(df, unique).groupBy("c").agg(F.count_if(~is_null_slot()).alias("u")).collect()
        facts |= {("uniques", c): 0 for c in unique} | {("uniques", unique[r["c"]]): r["u"] for r in counted}
    return facts


def check_data_quality(
    df: DataFrame, rules: Sequence[Rule] | None = None, index: str = INDEX, thresholds: Thresholds = DEFAULTS
) -> QualityReport:
    """Scores from full-data counts; the overall score is the mean of the unrounded rule scores."""
    rules = DEFAULT_RULES if rules is None else rules
    facts = _facts(df, rules, index)
    n = facts["rows",]
    share = lambda count: count / n if n else 0.0
    names, results = data_columns(df, None, index), []

    def add(kind, column, passed, score, affected=0, metric=None, limit=None, severity=None, advice=None):
        issue = (None, None, None, None) if passed else (int(affected), metric, limit, severity)
        results.append((kind, column, bool(passed), score, *issue, advice))

    for rule in rules:
        if isinstance(rule, Completeness):
            for c in rule.columns or names:
                if c in df.columns:
                    nulls = facts["nulls", c]
                    ratio = 1 - share(nulls)
                    add("completeness", c, ratio >= rule.threshold, ratio * 100, nulls, ratio, rule.threshold,
                        "high" if ratio < thresholds.low_completeness else "medium")
        elif isinstance(rule, Duplicates):
            twins = duplicate_count(df, rule.columns, index).first()["duplicates"]
            ratio = share(twins)
            passed = ratio <= rule.threshold
            add("duplicates", None, passed, (1 - ratio) * 100, twins, ratio, rule.threshold,
                "high" if ratio > thresholds.high_duplicates else "medium",
                None if passed else "remove duplicate rows with remove_duplicates")
        elif isinstance(rule, Uniqueness):
            if rule.column in df.columns:
                ratio = share(facts["uniques", rule.column])
                if rule.expected_unique:
                    add("uniqueness", rule.column, ratio >= thresholds.uniqueness, ratio * 100,
                        n - facts["uniques", rule.column], ratio, thresholds.uniqueness, "high")
                else:
                    add("uniqueness", rule.column, True, 100.0)
        elif isinstance(rule, DataTypes):
            for c in names:
                known = n - facts["nulls", c]
                if known > 0:
                    one = not rule.by_form or facts.get(("forms", c), 1) <= 1
                    # numbers stored as text are reported
                    as_text = facts.get(("numeric_text", c), 0) / known > thresholds.numeric_text_share
                    add("data_type_consistency", c, one, 100.0 if one else 50.0, severity="medium",
                        advice=f"column {c} holds numbers as text; convert it with change_column_type" if as_text else None)
        elif isinstance(rule, Outliers):
            for c in numeric_columns(df, None, index):
                ratio = share(facts["outliers", c])
                add("outliers", c, ratio <= rule.threshold, (1 - min(ratio, 1)) * 100, facts["outliers", c], ratio,
                    rule.threshold, "medium")
        elif _date_pair(df, rule, index):
            bad = facts["inconsistent", *_date_pair(df, rule, index)]
            ratio = 1 - share(bad)
            add("consistency", None, ratio >= thresholds.uniqueness, ratio * 100, bad, ratio, thresholds.uniqueness, "high")
    return _report(df, results, thresholds)


def _report(df, results, thresholds):
    overall = round(sum(r[3] for r in results) / len(results), 2) if results else 100.0
    advice = [r[8] for r in results if r[8]]
    if not advice and overall < thresholds.advice_score:
        advice.append("run profile_data for an overview of the data")
    passed = sum(r[2] for r in results)
    spark = df.sparkSession
    rules = spark.createDataFrame([(*r[:3], round(r[3], 2), *r[4:]) for r in results], _RESULT)
    summary = spark.createDataFrame(
        [(overall, passed, len(results) - passed, len(results) - passed, "; ".join(advice))],
        "overall_score double, passed_rules bigint, failed_rules bigint, total_issues bigint, recommendations string",
    )
    return QualityReport(rules, summary)
