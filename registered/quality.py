"""Schema validation, quality scores and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

import tablekit as tk
from tablekit.streaming.watch import stream_checks as checks_of, stream_metrics as merged, watch

from .base import HOLED, I, holed_events, indexed, query, rounded, scratch_path, table

_SCHEMA = {
    "user_id": {"greater_than": 2, "less_than": 140, "not_equal_to": 77},
    "event_type": {"nullable": False, "isin": ["view", "click", "purchase", "error"], "str_length": {"min": 5}},
    "value": {"nullable": True, "in_range": {"min": 1.0, "max": 200.0}, "ignore_na": False},
    "country": {"nullable": False},
}


def _violation(column, check, condition, source=HOLED):
    return f"""SELECT '{column}' AS "column", '{check}' AS check_name, __row_index__::BIGINT AS __row_index__,
  {column}::VARCHAR AS failure_case FROM {source} WHERE {condition}"""


_EVENT_CHECKS = [
    ("user_id", "greater_than", "user_id <= 2"), ("user_id", "less_than", "user_id >= 140"),
    ("user_id", "not_equal_to", "user_id = 77"), ("event_type", "not_nullable", "event_type IS NULL"),
    ("event_type", "isin", "event_type = 'signup'"), ("event_type", "str_length", "length(event_type) < 5"),
]


@query("validate_violations", " UNION ALL ".join(
    [_violation(*x) for x in _EVENT_CHECKS]
    + ["""SELECT 'country' AS "column", 'column_missing' AS check_name, NULL::BIGINT, NULL FROM region WHERE r_regionkey = 0"""]))
def validate_violations(spark, d):
    schema = {c: r for c, r in _SCHEMA.items() if c != "value"}
    return tk.schema_violations(holed_events(spark, d), schema)


def _check(column, check, condition, source=HOLED):
    return f"""SELECT '{column}' AS "column", '{check}' AS check_name, count(*) FILTER (WHERE {condition})::BIGINT AS violations
  FROM {source}"""


@query("validate_checks", " UNION ALL ".join(
    [_check(*x) for x in _EVENT_CHECKS] + [_check("value", "in_range", "value IS NULL OR value < 1 OR value > 200")]
    + ["""SELECT 'country' AS "column", 'column_missing' AS check_name, 1::BIGINT AS violations FROM region WHERE r_regionkey = 0"""]))
def validate_checks(spark, d):
    return tk.schema_checks(holed_events(spark, d), _SCHEMA)


_ALL_CHECKS = " UNION ALL ".join(
    [_check(*x) for x in _EVENT_CHECKS] + [_check("value", "in_range", "value IS NULL OR value < 1 OR value > 200")]
    + ["SELECT 'country', 'column_missing', 1 FROM region WHERE r_regionkey = 0"])


@query("validate_summary", f"""SELECT bool_and(v = 0) AS valid, count(*)::BIGINT AS total_columns, count(*) FILTER (WHERE v = 0)::BIGINT AS valid_columns,
  count(*) FILTER (WHERE v > 0)::BIGINT AS invalid_columns, 'country' AS missing_columns, 'event_id' AS extra_columns, sum(v)::BIGINT AS violations
  FROM (SELECT "column", sum(violations) AS v FROM ({_ALL_CHECKS}) GROUP BY 1)""")
def validate_summary(spark, d):
    return tk.schema_summary(holed_events(spark, d), _SCHEMA)


_PAGES = "(SELECT page_id AS __row_index__, page_id, url FROM pages)"


@query("validate_text", " UNION ALL ".join([
    _violation("url", "str_contains", "NOT regexp_matches(url, 'example')", _PAGES),
    _violation("url", "str_startswith", "NOT starts_with(url, 'https://')", _PAGES),
    _violation("url", "str_endswith", "NOT suffix(url, '5')", _PAGES),
    _violation("url", "str_matches", "NOT regexp_matches(url, '^(?:https?://[a-z.]+/(en|de)/)')", _PAGES),
    _violation("page_id", "equal_to", "page_id <> 3", _PAGES),
    _violation("page_id", "greater_than_or_equal_to", "page_id < 5", _PAGES),
    _violation("page_id", "less_than_or_equal_to", "page_id > 90", _PAGES),
    _violation("page_id", "notin", "page_id IN (1, 4)", _PAGES)]))
def validate_text(spark, d):
    return tk.schema_violations(indexed(spark, d, "pages"), {
        "url": tk.ColumnRules(str_contains="example", str_startswith="https://", str_endswith="5",
                              str_matches="https?://[a-z.]+/(en|de)/"),
        "page_id": tk.ColumnRules(equal_to=3, greater_than_or_equal_to=5, less_than_or_equal_to=90, notin=[1, 4]),
    })


@query("validate_unique", """SELECT 'o_custkey' AS "column", 'unique' AS check_name, o_orderkey AS __row_index__,
  o_custkey::VARCHAR AS failure_case FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1""")
def validate_unique(spark, d):
    return tk.schema_violations(indexed(spark, d, "orders"), {
        "o_custkey": {"unique": True}, "o_orderkey": {"unique": True},
    })


_BAD_DATES = """(SELECT *, CASE WHEN o_orderkey % 100 = 0 THEN o_orderdate - INTERVAL 1 DAY
  ELSE o_orderdate + INTERVAL 3 DAY END AS shipped FROM orders)"""


def _dated_orders(spark, d):
    orders = table(spark, d, "orders")
    shift = F.when(F.col("o_orderkey") % 100 == 0, F.expr("INTERVAL -1 DAY")).otherwise(F.expr("INTERVAL 3 DAY"))
    return orders.withColumn("shipped", F.col("o_orderdate") + shift)


def _score(rule, column, metric, passed, score, source):
    column = f"'{column}'" if column else "NULL"
    return f"""SELECT '{rule}' AS rule_type, {column} AS "column", {passed} AS passed, round({score}, 2) AS score
  FROM (SELECT {metric} AS x FROM {source})"""


def _outlier_score(column, source):
    bounds = f"""(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT
      quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source}))"""
    return _score("outliers", column, f"count(*) FILTER (WHERE {column} < lo OR {column} > hi) / count(*)",
                  "x <= 0.05", "(1 - x) * 100", f"{source}, {bounds}")


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "shipped")
_ORDER_SCORES = " UNION ALL ".join(
    [_score("completeness", c, f"count({c}) / count(*)", "x >= 0.95", "x * 100", _BAD_DATES) for c in _ORDER_COLUMNS]
    + [_score("duplicates", None, "0.0", "true", "100.0", "(SELECT 1)")]
    + [_score("data_type_consistency", c, "0.0", "true", "100.0", "(SELECT 1)") for c in _ORDER_COLUMNS]
    + [_outlier_score(c, _BAD_DATES) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [_score("consistency", None, "count(*) FILTER (WHERE o_orderdate > shipped) / count(*)", "1 - x >= 0.99", "(1 - x) * 100",
              _BAD_DATES)])


@query("quality_scores", _ORDER_SCORES)
def quality_scores(spark, d):
    report = tk.check_data_quality(_dated_orders(spark, d))
    return report.rules.select("rule_type", "column", "passed", "score")


@query("quality_scores_with_nulls", " UNION ALL ".join(
    [_score("completeness", c, f"count({c}) / count(*)", "x >= 0.95", "x * 100", HOLED) for c in ("value", "event_type")]
    + [_score("duplicates", None, "(count(*) - count(DISTINCT (user_id, event_type))) / count(*)", "x <= 0.01", "(1 - x) * 100", HOLED)]
    + [_score("uniqueness", c, f"count(DISTINCT {c}) / count(*)", "x >= 0.99", "x * 100", HOLED) for c in ("event_id", "user_id")]
    + [_outlier_score(c, HOLED) for c in ("event_id", "user_id", "value")]))
def quality_scores_with_nulls(spark, d):
    events = holed_events(spark, d)
    rules = [tk.Completeness(columns=["value", "event_type"]), tk.Duplicates(columns=["user_id", "event_type"]),
             tk.Uniqueness("event_id"), tk.Uniqueness("user_id"), tk.Outliers()]
    return tk.check_data_quality(events, rules).rules.select("rule_type", "column", "passed", "score")


@query("quality_issues", f"""SELECT 'completeness' AS rule_type, 'value' AS "column", (count(*) - count(value))::BIGINT AS affected_rows,
  round(count(value) / count(*), 6) AS metric_value, 0.95::DOUBLE AS threshold, 'medium' AS severity FROM {HOLED}
  UNION ALL SELECT 'completeness', 'event_type', count(*) - count(event_type), round(count(event_type) / count(*), 6), 0.95, 'medium' FROM {HOLED}
  UNION ALL SELECT 'uniqueness', 'user_id', count(*) - count(DISTINCT user_id), round(count(DISTINCT user_id) / count(*), 6), 0.99, 'high' FROM {HOLED}""")
def quality_issues(spark, d):
    rules = [tk.Completeness(columns=["value", "event_type"]), tk.Uniqueness("event_id"), tk.Uniqueness("user_id")]
    failed = tk.check_data_quality(holed_events(spark, d), rules).rules.filter(~F.col("passed"))
    return rounded(failed.select("rule_type", "column", "affected_rows", "metric_value", "threshold", "severity"), 6)


@query("quality_overall", f"""SELECT round(avg(score), 2) AS overall_score, count(*) FILTER (WHERE passed)::BIGINT AS passed_rules,
  count(*) FILTER (WHERE NOT passed)::BIGINT AS failed_rules FROM ({_ORDER_SCORES})""")
def quality_overall(spark, d):
    report = tk.check_data_quality(_dated_orders(spark, d))
    return report.overall.select("overall_score", "passed_rules", "failed_rules")


def _stat_rule(column, source, sensitivity):
    return f"""FROM {source}, (SELECT avg({column}) AS m, stddev_samp({column}) AS s,
    quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source})
  WHERE abs(({column} - m) / s) > 3 * (1 - {sensitivity} + 0.5) OR {column} < q1 - 1.5 * (2 - {sensitivity}) * (q3 - q1)
    OR {column} > q3 + 1.5 * (2 - {sensitivity}) * (q3 - q1)"""


_STATISTICAL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", event_id AS __row_index__, round({c}, 4)::DOUBLE AS value {_stat_rule(c, HOLED, 0.95)}"""
    for c in ("user_id", "value"))


@query("anomalies_statistical", _STATISTICAL)
def anomalies_statistical(spark, d):
    found = tk.statistical_anomalies(holed_events(spark, d), ["user_id", "value"])
    return rounded(found.withColumn("value", F.col("value").cast("double")))


# one type in two thousand is spelled differently; the rest are upper case
_SPELLED = """(SELECT event_id, CASE WHEN event_id % 2000 = 0 THEN 'odd ' || event_id::VARCHAR
  ELSE upper(event_type) || (user_id % 6)::VARCHAR END AS label FROM events)"""


def _spelled_events(spark, d):
    label = F.when(F.col("event_id") % 2000 == 0, F.concat(F.lit("odd "), F.col("event_id").cast("string")))\
        .otherwise(F.concat(F.upper("event_type"), (F.col("user_id") % 6).cast("string")))
    return indexed(spark, d, "events").select(I, label.alias("label"))


_RARE = f"(SELECT label FROM {_SPELLED} GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM events) < (1 - 0.95) * 0.01)"


@query("anomalies_pattern", f"""SELECT 'label' AS "column", event_id AS __row_index__, label AS value FROM {_SPELLED}
  WHERE label IN {_RARE} OR ((SELECT count(*) FROM {_RARE}) > 0 AND label = lower(label))""")
def anomalies_pattern(spark, d):
    return tk.pattern_anomalies(_spelled_events(spark, d))


_GAPPED = """(SELECT event_id, CASE WHEN event_id % 13 IN (2, 3) THEN NULL ELSE value END AS pairs,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS fifths,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS few FROM events)"""


def _islands(column):
    return f"""SELECT '{column}' AS "column", count(*)::BIGINT AS missing_count,
  round(count(*) / (SELECT count(*) FROM events), 4) AS missing_ratio,
  (SELECT count(*) FROM (SELECT count(*) AS n FROM (SELECT event_id - row_number() OVER (ORDER BY event_id) AS g
    FROM {_GAPPED} WHERE {column} IS NULL) GROUP BY g) WHERE n > 1)::BIGINT AS sequential_clusters FROM {_GAPPED}
  WHERE {column} IS NULL"""


@query("anomalies_missing", f"""SELECT *, CASE WHEN sequential_clusters > 0 THEN 'clustered' ELSE 'random' END AS pattern
  FROM ({_islands("pairs")} UNION ALL {_islands("fifths")})""")
def anomalies_missing(spark, d):
    e, v = indexed(spark, d, "events"), F.col("value")
    k = F.col("event_id")
    return tk.missing_anomalies(e.select(
        I, F.when(~(k % 13).isin(2, 3), v).alias("pairs"), F.when(k % 5 != 0, v).alias("fifths"),
        F.when(k % 50 != 0, v).alias("few"),
    ))


@query("anomalies_summary", f"""SELECT count(*)::BIGINT AS total_anomalies, count(DISTINCT __row_index__)::BIGINT AS affected_rows,
  string_agg(DISTINCT "column", ',' ORDER BY "column") AS affected_columns FROM ({_STATISTICAL})""")
def anomalies_summary(spark, d):
    events = holed_events(spark, d).select(I, "user_id", "value")
    return tk.find_anomalies(events, ["user_id", "value"], methods=["statistical"]).summary


@query("anomalies_by_column", f"""SELECT 'statistical' AS method, "column", count(*)::BIGINT AS anomaly_count FROM ({_STATISTICAL}) GROUP BY 2""")
def anomalies_by_column(spark, d):
    events = holed_events(spark, d).select(I, "user_id", "value")
    return tk.find_anomalies(events, ["user_id", "value"], methods=["statistical"]).by_column.select("method", "column", "anomaly_count")


@query("anomalies_by_method", f"""SELECT 'statistical' AS method, 'value' AS "column", count(*)::BIGINT AS anomaly_count
  FROM ({_STATISTICAL}) WHERE "column" = 'value'
  UNION ALL SELECT 'missing', 'value', (count(*) - count(value))::BIGINT FROM {HOLED}""")
def anomalies_by_method(spark, d):
    report = tk.find_anomalies(holed_events(spark, d), ["value", "event_type"])
    return report.by_method.select("method", "column", "anomaly_count")


def _watched(spark, d):
    """``events``, read as a stream, with metrics and checks of every batch kept."""
    files = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    holed = files.select(
        F.col("event_id").alias(I), "event_id", "user_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )
    path = scratch_path(spark)
    schema = {c: r for c, r in _SCHEMA.items() if c != "country"}
    run = watch(holed, path, schema).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return path


@query("stream_metrics", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*)::BIGINT AS rows, (count(*) - count({c}))::BIGINT AS nulls,
  round({"avg(%s)" % c if c != "event_type" else "NULL::DOUBLE"}, 6) AS mean, round({"stddev_samp(%s)" % c if c != "event_type" else "NULL::DOUBLE"}, 6) AS std,
  {"max(%s)::DOUBLE" % c if c != "event_type" else "NULL::DOUBLE"} AS max FROM {HOLED}""" for c in ("user_id", "event_type", "value")))
def stream_metrics(spark, d):
    found = merged(spark, _watched(spark, d)).where(F.col("column") != "event_id")
    return found.select("column", "rows", "nulls", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "max")


@query("stream_checks", " UNION ALL ".join([_check(*x) for x in _EVENT_CHECKS] + [_check("value", "in_range", "value IS NULL OR value < 1 OR value > 200")]))
def stream_checks(spark, d):
    return checks_of(spark, _watched(spark, d))
