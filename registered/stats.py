"""Grouped aggregates, statistics, correlations, value counts, outliers and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

import tablekit as tk

from .base import HOLED, holed_events, query, rounded, table


@query("group_aggregate", """SELECT o_orderpriority, count(o_totalprice)::BIGINT AS o_totalprice_count,
  round(avg(o_totalprice), 4) AS o_totalprice_mean, round(quantile_cont(o_totalprice, 0.5), 4) AS o_totalprice_median,
  round(stddev_samp(o_totalprice), 4) AS o_totalprice_std FROM orders
  WHERE o_orderstatus = 'O' AND o_totalprice > 100000 GROUP BY 1""")
def group_aggregate(spark, d):
    open_orders = tk.filter_rows(table(spark, d, "orders"), [("o_orderstatus", "=", "O"), ("o_totalprice", ">", 100000.0)])
    return rounded(tk.group_by_aggregate(open_orders, ["o_orderpriority"], {"o_totalprice": ["count", "mean", "median", "std"]}))


@query("group_aggregate_all", f"""SELECT user_id, event_type, count(value)::BIGINT AS value_count, round(avg(value), 9) AS value_mean,
  round(quantile_cont(value, 0.5), 9) AS value_median, round(coalesce(sum(value), 0), 9) AS value_sum, min(value) AS value_min,
  max(value) AS value_max, round(stddev_samp(value), 9) AS value_std, round(var_samp(value), 9) AS value_var,
  arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value_first,
  arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value_last, count(DISTINCT value)::BIGINT AS value_nunique
  FROM {HOLED} WHERE event_type IS NOT NULL GROUP BY 1, 2""")
def group_aggregate_all(spark, d):
    functions = ["count", "mean", "median", "sum", "min", "max", "std", "var", "first", "last", "nunique"]
    return rounded(tk.group_by_aggregate(holed_events(spark, d), ["user_id", "event_type"], {"value": functions}), 9)


@query("group_medians_wide", """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS l_extendedprice_median,
  quantile_cont(l_quantity, 0.5) AS l_quantity_median FROM lineitem GROUP BY 1""")
def group_medians_wide(spark, d):
    """The way for groups whose distinct values do not fit one task, forced by a limit of 0."""
    return tk.group_by_aggregate(
        table(spark, d, "lineitem"), ["l_returnflag"], {"l_extendedprice": "median", "l_quantity": "median"},
        distinct_limit=0,
    )


@query("group_stats", """SELECT l_returnflag || '_' || l_linestatus AS group_key, l_returnflag, l_linestatus,
  count(*)::BIGINT AS count, round(avg(l_quantity), 4) AS mean, round(sum(l_quantity), 4) AS sum,
  min(l_quantity) AS min, max(l_quantity) AS max, round(stddev_samp(l_quantity), 4) AS std FROM lineitem GROUP BY 2, 3""")
def group_stats(spark, d):
    items = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    return rounded(tk.group_stats(items, ["l_returnflag", "l_linestatus"]))


def _describe(column, source):
    return f"""SELECT '{column}' AS "column", count({column})::BIGINT AS count, round(coalesce(avg({column}), 0), 4) AS mean,
  round(coalesce(stddev_samp({column}), 0), 4) AS std, min({column})::DOUBLE AS min,
  round(quantile_cont({column}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({column}::DOUBLE, 0.5), 4) AS p50,
  round(quantile_cont({column}::DOUBLE, 0.75), 4) AS p75, max({column})::DOUBLE AS max FROM {source}"""


@query("statistics", " UNION ALL ".join(
    _describe(c, "lineitem") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")))
def statistics(spark, d):
    return rounded(tk.get_statistics(table(spark, d, "lineitem")))


@query("statistics_with_nulls", " UNION ALL ".join(_describe(c, HOLED) for c in ("event_id", "user_id", "value")))
def statistics_with_nulls(spark, d):
    return rounded(tk.get_statistics(holed_events(spark, d)))


_TEXT_STATS = """SELECT '{0}' AS "column", 'object' AS data_type, count({0})::BIGINT AS count, count(DISTINCT {0})::BIGINT AS "unique",
  NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75,
  NULL::DOUBLE AS max, (SELECT {0} FROM {1} WHERE {0} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
  (SELECT count(*) FROM {1} WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC LIMIT 1)::BIGINT AS freq FROM {1}"""
_NUMBER_STATS = """SELECT "column", '{2}' AS data_type, count, (SELECT count(DISTINCT {0}) FROM {1})::BIGINT AS "unique",
  mean, std, min, p25, p50, p75, max, NULL AS top, NULL::BIGINT AS freq FROM ({3})"""


@query("column_statistics", " UNION ALL ".join([
    _TEXT_STATS.format("event_type", HOLED),
    _NUMBER_STATS.format("value", HOLED, "float64", _describe("value", HOLED)),
    _NUMBER_STATS.format("user_id", HOLED, "int64", _describe("user_id", HOLED)),
]))
def column_statistics(spark, d):
    return rounded(tk.get_column_statistics(holed_events(spark, d), ["event_type", "value", "user_id"]))


@query("categorical_statistics", " UNION ALL ".join(
    _TEXT_STATS.format(c, "orders") for c in ("o_orderstatus", "o_orderpriority")))
def categorical_statistics(spark, d):
    return rounded(tk.get_column_statistics(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


def _pairs(columns, expression, source):
    parts = []
    for a in columns:
        for b in columns:
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, round({expression(a, b)}, 6) AS r FROM {source(a, b)}")
    return " UNION ALL ".join(parts)


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_pearson", _pairs(_NUMBERS, lambda a, b: "1.0" if a == b else f"corr({a}, {b})",
                                     lambda a, b: "(SELECT 1)" if a == b else "lineitem"))
def correlation_pearson(spark, d):
    return rounded(tk.get_correlation_matrix(table(spark, d, "lineitem"), "pearson", list(_NUMBERS)), 6)


_CONSTANT = f"(SELECT event_id, user_id, value, 3.0::DOUBLE AS same FROM {HOLED})"


@query("correlation_pearson_nulls", _pairs(
    ("event_id", "user_id", "value", "same"),
    lambda a, b: "0.0" if "same" in (a, b) else "1.0" if a == b else f"corr({a}, {b})",
    lambda a, b: "(SELECT 1)" if a == b or "same" in (a, b) else _CONSTANT))
def correlation_pearson_nulls(spark, d):
    events = holed_events(spark, d).withColumn("same", F.lit(3.0))
    return rounded(tk.get_correlation_matrix(events, "pearson", ["event_id", "user_id", "value", "same"]), 6)


@query("correlation_strong", """SELECT a AS col1, b AS col2, r FROM (
  SELECT 'o_orderkey' AS a, 'o_orderkey' AS b, 1.0 AS r UNION ALL SELECT 'double_price', 'double_price', 1.0
  UNION ALL SELECT 'o_totalprice', 'o_totalprice', 1.0
  UNION ALL SELECT 'o_totalprice', 'double_price', 1.0 UNION ALL SELECT 'double_price', 'o_totalprice', 1.0)""")
def correlation_strong(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("double_price"))
    return rounded(tk.get_correlation_matrix(orders, "pearson", min_correlation=0.3), 6)


def _rank(a, source):
    return f"(rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0)"


@query("correlation_spearman", _pairs(
    _NUMBERS, lambda a, b: "1.0" if a == b else "corr(x, y)",
    lambda a, b: "(SELECT 1)" if a == b else f"(SELECT {_rank(a, '')} AS x, {_rank(b, '')} AS y FROM lineitem)"))
def correlation_spearman(spark, d):
    return rounded(tk.get_correlation_matrix(table(spark, d, "lineitem"), "spearman", list(_NUMBERS)), 6)


@query("correlation_spearman_nulls", _pairs(
    ("user_id", "value"), lambda a, b: "1.0" if a == b else "corr(x, y)",
    lambda a, b: "(SELECT 1)" if a == b else
    f"(SELECT {_rank(a, '')} AS x, {_rank(b, '')} AS y FROM {HOLED} WHERE value IS NOT NULL)"))
def correlation_spearman_nulls(spark, d):
    return rounded(tk.get_correlation_matrix(holed_events(spark, d), "spearman", ["user_id", "value"]), 6)


@query("correlation_kendall", _pairs(
    ("c_nationkey", "c_acctbal"), lambda a, b: "1.0" if a == b else
    "sum(sign(p.c_nationkey - q.c_nationkey) * sign(p.c_acctbal - q.c_acctbal)) / "
    "(sqrt(sum(abs(sign(p.c_nationkey - q.c_nationkey)))) * sqrt(sum(abs(sign(p.c_acctbal - q.c_acctbal)))))",
    lambda a, b: "(SELECT 1)" if a == b else "customer p, customer q"))
def correlation_kendall(spark, d):
    return rounded(tk.get_correlation_matrix(table(spark, d, "customer"), "kendall", ["c_nationkey", "c_acctbal"]), 6)


@query("value_counts", f"""SELECT event_type AS value, count(*)::BIGINT AS count,
  (SELECT count(event_type) FROM {HOLED})::BIGINT AS total_values,
  (SELECT count(DISTINCT event_type) FROM {HOLED})::BIGINT AS unique_values
  FROM {HOLED} WHERE event_type IS NOT NULL GROUP BY 1""")
def value_counts(spark, d):
    return tk.value_counts(holed_events(spark, d), "event_type")


@query("value_counts_top", """SELECT user_id AS value, round(count(*) / (SELECT count(*) FROM events), 6) AS share,
  (SELECT count(*) FROM events)::BIGINT AS total_values, (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS unique_values
  FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 20""")
def value_counts_top(spark, d):
    return rounded(tk.value_counts(table(spark, d, "events"), "user_id", normalize=True, top_n=20), 6)


_BOUNDS = """(SELECT q1, q3, q3 - q1 AS iqr, q1 - {1} * (q3 - q1) AS lo, q3 + {1} * (q3 - q1) AS hi FROM
  (SELECT quantile_cont({0}, 0.25) AS q1, quantile_cont({0}, 0.75) AS q3 FROM {2}))"""


@query("outliers_iqr", f"""SELECT '{{0}}' AS "column", event_id AS __row_index__, value,
  round(CASE WHEN value < lo THEN (lo - value) / iqr ELSE (value - hi) / iqr END, 6) AS score
  FROM {HOLED}, {_BOUNDS.format("value", 1.5, HOLED)} WHERE value < lo OR value > hi""".replace("{0}", "value"))
def outliers_iqr(spark, d):
    return rounded(tk.detect_outliers(holed_events(spark, d)), 6)


@query("outliers_zscore", f"""SELECT 'value' AS "column", event_id AS __row_index__, value,
  round(abs((value - m) / s), 6) AS score
  FROM {HOLED}, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM {HOLED}) WHERE abs((value - m) / s) > 3""")
def outliers_zscore(spark, d):
    return rounded(tk.detect_outliers(holed_events(spark, d), method="zscore", threshold=3.0), 6)


@query("outliers_first_rows", f"""SELECT 'value' AS "column", event_id AS __row_index__, value,
  round((value - hi) / iqr, 6) AS score FROM {HOLED}, {_BOUNDS.format("value", 1.5, HOLED)} WHERE value > hi
  ORDER BY event_id LIMIT 100""")
def outliers_first_rows(spark, d):
    return rounded(tk.detect_outliers(holed_events(spark, d), ["value"], per_column_cap=100), 6)


@query("outlier_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < lo OR {c} > hi)::BIGINT AS outliers
  FROM lineitem, {_BOUNDS.format(c, 0.6, "lineitem")}""" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def outlier_counts(spark, d):
    items = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    return tk.outlier_counts(items, threshold=0.6)


_TOP = """(SELECT {0}::VARCHAR AS v, count(*) AS n FROM {1} GROUP BY {0} ORDER BY count(*) DESC, {0} NULLS LAST LIMIT 1)"""


def _profile(c, source, dtype):
    return f"""SELECT '{c}' AS "column", '{dtype}' AS data_type, (count(*) - count({c}))::BIGINT AS null_count,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_percentage, count(DISTINCT {c})::BIGINT AS unique_count,
  round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS unique_percentage,
  (SELECT v FROM {_TOP.format(c, source)}) AS most_frequent, (SELECT n FROM {_TOP.format(c, source)})::BIGINT AS frequency
  FROM {source}"""


@query("profile", " UNION ALL ".join([
    _profile("event_id", HOLED, "int64"), _profile("user_id", HOLED, "int64"), _profile("event_type", HOLED, "object"),
    _profile("value", HOLED, "float64")]))
def profile(spark, d):
    return tk.profile_data(holed_events(spark, d))


@query("profile_customer", " UNION ALL ".join([
    _profile("c_custkey", "customer", "int64"), _profile("c_name", "customer", "object"),
    _profile("c_nationkey", "customer", "int64"), _profile("c_mktsegment", "customer", "object"),
    _profile("c_acctbal", "customer", "float64")]))
def profile_customer(spark, d):
    return tk.profile_data(table(spark, d, "customer"))


def _summary(c, dtype, kind):
    return f"""SELECT '{c}' AS "column", '{dtype}' AS type, '{kind}' AS kind, count({c}) < count(*) AS nullable,
  count(DISTINCT {c})::BIGINT AS unique_count, (count(*) - count({c}))::BIGINT AS null_count FROM {HOLED}"""


@query("data_summary", " UNION ALL ".join([
    _summary("event_id", "int64", "numeric"), _summary("user_id", "int64", "numeric"),
    _summary("event_type", "object", "text"), _summary("value", "float64", "numeric")]))
def data_summary(spark, d):
    return tk.get_data_summary(holed_events(spark, d))


@query("table_summary", f"""SELECT count(*)::BIGINT AS rows, 4::BIGINT AS columns,
  (2 * count(*) - count(value) - count(event_type))::BIGINT AS total_missing,
  round((2 * count(*) - count(value) - count(event_type)) * 100.0 / (count(*) * 4), 2) AS missing_percentage,
  3::BIGINT AS numeric_columns, 1::BIGINT AS text_columns, 0::BIGINT AS datetime_columns, 0::BIGINT AS boolean_columns
  FROM {HOLED}""")
def table_summary(spark, d):
    return tk.get_table_summary(holed_events(spark, d))


@query("value_forms", """SELECT 'mixed' AS "column", count(*) FILTER (WHERE event_id % 5 = 0)::BIGINT AS boolean_values,
  count(*) FILTER (WHERE event_id % 5 = 1)::BIGINT AS integer_values, count(*) FILTER (WHERE event_id % 5 = 2)::BIGINT AS float_values,
  count(*) FILTER (WHERE event_id % 5 = 3)::BIGINT AS date_values, count(*) FILTER (WHERE event_id % 5 = 4)::BIGINT AS text_values
  FROM events""")
def value_forms(spark, d):
    k = F.col("event_id") % 5
    mixed = F.when(k == 0, F.lit("true")).when(k == 1, F.col("user_id").cast("string"))\
        .when(k == 2, F.col("value").cast("string")).when(k == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.col("event_type"))
    return tk.value_forms(table(spark, d, "events").select(mixed.alias("mixed")))


@query("table_checks", """SELECT 'info' AS severity, 'high_cardinality' AS issue, 'name' AS "column" FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'info', 'potential_datetime', 'day' FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'warning', 'all_null', 'nothing' FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'warning', 'mixed_forms', 'mixed' FROM region WHERE r_regionkey = 0""")
def table_checks(spark, d):
    orders = table(spark, d, "orders")
    return tk.validate_dataframe(orders.select(
        F.concat(F.lit("order "), "o_orderkey").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("12")).otherwise(F.lit("twelve")).alias("mixed"),
    ))


