"""Queries for the ways that large or awkward inputs take: long mappings, ragged files, ties, blocks, spread keys."""

from __future__ import annotations

from pyspark.sql import functions as F

import tablekit as tk
from tablekit.plans.quantiles import quantiles

from .base import HOLED, I, holed_events, indexed, query, scratch_path, table


@query("read_csv_ragged_preamble", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def read_csv_ragged_preamble(spark, d):
    """A one-field line above the header, in one small file."""
    path = scratch_path(spark)
    body = table(spark, d, "nation").select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("line"), F.lit(2).alias("k"))
    head = spark.createDataFrame([("report of may", 0), ("n_nationkey,n_name,n_regionkey", 1)], "line string, k int")
    head.unionByName(body).repartition(1).sortWithinPartitions("k").select("line").write.text(path)
    return tk.read_csv(spark, path, header="row", header_row=1).drop(I)


@query("read_csv_quoted_newlines", "SELECT doc_id, text, lang FROM documents")
def read_csv_quoted_newlines(spark, d):
    path = scratch_path(spark)
    table(spark, d, "documents").select("doc_id", "text", "lang").write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tk.read_csv(spark, path, row_index=False)


@query("read_csv_utf16", "SELECT doc_id, text, lang, n_chars FROM documents")
def read_csv_utf16(spark, d):
    """Two bytes a character, with line breaks in quotes."""
    path = scratch_path(spark)
    table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars").write.options(
        header=True, encoding="UTF-16LE", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tk.read_csv(spark, path, encoding="UTF-16LE", row_index=False)


@query("read_csv_row_index", """SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS __row_index__, s_suppkey, s_name FROM supplier""")
def read_csv_row_index(spark, d):
    """Four files, in key order."""
    path = scratch_path(spark)
    ordered = table(spark, d, "supplier").select("s_suppkey", "s_name").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey")
    ordered.write.csv(path, header=True)
    return tk.read_csv(spark, path)


@query("row_index_many_files", """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __row_index__, o_orderkey FROM orders""")
def row_index_many_files(spark, d):
    path = scratch_path(spark)
    table(spark, d, "orders").select("o_orderkey").repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return tk.read_parquet(spark, path)


@query("update_map_large", """SELECT o_orderkey, CASE WHEN o_custkey < 2000 THEN 'c' || o_custkey END AS o_custkey FROM orders""")
def update_map_large(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return tk.map_values(orders, "o_custkey", {k: f"c{k}" for k in range(2000)})


@query("map_shuffled", """SELECT l_orderkey, l_linenumber, l_returnflag AS kept,
  CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS l_returnflag FROM lineitem""")
def map_shuffled(spark, d):
    """Three hot values, by the salted join."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kept"), "l_returnflag")
    mapping = spark.createDataFrame([("A", "accepted"), ("R", "returned")], "key string, value string")
    return tk.map_values(items, "l_returnflag", mapping, broadcast_rows=0)


@query("fill_forward_blocks", f"""SELECT __row_index__, event_id, user_id,
  coalesce(event_type, last_value(event_type IGNORE NULLS) OVER w) AS event_type,
  coalesce(value, last_value(value IGNORE NULLS) OVER w) AS value FROM {HOLED}
  WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def fill_forward_blocks(spark, d):
    """Blocks of 64 rows: values are carried across blocks, and across blocks of blocks."""
    return tk.fill_missing_values(holed_events(spark, d), "forward", columns=["event_type", "value"], block_bits=6)


@query("validate_first_errors", """SELECT 'o_totalprice' AS "column", 'less_than' AS check_name, o_orderkey AS __row_index__,
  o_totalprice::VARCHAR AS failure_case FROM orders WHERE o_totalprice >= 100000 ORDER BY o_orderkey LIMIT 50""")
def validate_first_errors(spark, d):
    """A report of the first 50 violations; ``orders`` is in key order."""
    found = tk.schema_violations(indexed(spark, d, "orders"), {"o_totalprice": {"less_than": 100000.0}}, max_errors=50)
    return found


@query("table_checks_late", """SELECT 'warning' AS severity, 'mixed_forms' AS issue, 'late' AS "column" FROM orders
    HAVING count(*) FILTER (WHERE o_orderkey < 200) > 0 AND count(*) FILTER (WHERE o_orderkey >= 200) > 0
  UNION ALL SELECT 'info', 'potential_datetime', 'late' FROM orders HAVING count(*) FILTER (WHERE o_orderkey >= 200) = 0
  UNION ALL SELECT 'info', 'potential_datetime', 'day' FROM orders HAVING count(o_orderdate) > 0
  UNION ALL SELECT 'info', 'high_cardinality', 'late' FROM orders
    HAVING count(DISTINCT CASE WHEN o_orderkey < 200 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'not a date' END) > 0.9 * count(*)
  UNION ALL SELECT 'info', 'high_cardinality', 'day' FROM orders HAVING count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) > 0.9 * count(*)""")
def table_checks_late(spark, d):
    """A column of dates that turns into something else after the first rows."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    late = F.when(F.col("o_orderkey") < 200, day).otherwise(F.lit("not a date"))
    return tk.validate_dataframe(table(spark, d, "orders").select(late.alias("late"), day.alias("day")))


@query("filter_text_nan", f"""SELECT event_id FROM {HOLED} WHERE value IS NULL OR value::VARCHAR NOT LIKE '%7%'""")
def filter_text_nan(spark, d):
    """NaN is a missing cell for text conditions too: it holds no "a" and doesn't start with "N"."""
    e = holed_events(spark, d).select("event_id", F.coalesce("value", F.lit(float("nan"))).alias("value"))
    kept = tk.filter_rows(e, [("value", "not_contains", "a"), ("value", "not_contains", "7")])
    none = tk.filter_rows(e, [("value", "starts_with", "N"), ("value", "ends_with", "N"), ("value", "contains", "N")], mode="or")
    return kept.select("event_id").unionByName(none.select("event_id"))


@query("text_replace_unicode", r"""SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Pc}]+', '_', 'g') AS text FROM documents""")
def text_replace_unicode(spark, d):
    return tk.replace_in_column(table(spark, d, "documents").select("doc_id", "text"), "text", r"\W+", "_")


@query("group_sum_exact", """SELECT o_orderstatus, sum(CASE WHEN o_orderkey % 1000 = 0 THEN 9007199254740993 ELSE o_orderkey END)::BIGINT AS big_sum,
  sum(o_totalprice::DECIMAL(12, 2)) AS price_sum FROM orders GROUP BY 1""")
def group_sum_exact(spark, d):
    """Whole numbers and decimals keep their kind in a sum."""
    orders = table(spark, d, "orders").select(
        "o_orderstatus", F.when(F.col("o_orderkey") % 1000 == 0, F.lit(9007199254740993)).otherwise(F.col("o_orderkey")).alias("big"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return tk.group_by_aggregate(orders, ["o_orderstatus"], {"big": "sum", "price": "sum"})


_DECIMALS = """(SELECT event_id, CASE event_id % 4 WHEN 0 THEN 10.50 WHEN 1 THEN 9.50 END::DECIMAL(6, 2) AS v FROM events)"""


@query("fill_mode_decimal", f"""SELECT event_id, coalesce(v, (SELECT v FROM {_DECIMALS} WHERE v IS NOT NULL
  GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS v FROM {_DECIMALS}""")
def fill_mode_decimal(spark, d):
    """Ties go to the smaller number, not the smaller text."""
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.lit("10.50")).when(k == 1, F.lit("9.50")).cast("decimal(6,2)")
    return tk.fill_missing_values(table(spark, d, "events").select("event_id", v.alias("v")), "mode", columns=["v"], index="event_id")


@query("group_spread", """SELECT l_returnflag, sum(l_quantity) AS l_quantity_sum, min(l_extendedprice) AS l_extendedprice_min,
  round(var_samp(l_discount), 8) AS "l discount" FROM lineitem GROUP BY 1""")
def group_spread(spark, d):
    """``sum``, ``min`` and ``var``, with a blank in a column's name."""
    items = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", F.col("l_discount").alias("l disc"))
    got = tk.group_by_aggregate(items, ["l_returnflag"], {"l_quantity": "sum", "l_extendedprice": "min", "l disc": "var"})
    return got.select("l_returnflag", "l_quantity_sum", "l_extendedprice_min", F.round(F.col("l disc_var"), 8).alias("l discount"))


@query("quality_mixed_types", """SELECT 'data_type_consistency' AS rule_type, 'mixed' AS "column",
    count(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'integer' ELSE 'text' END) = 1 AS passed,
    CASE WHEN count(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'integer' ELSE 'text' END) = 1 THEN 100.0 ELSE 50.0 END::DOUBLE AS score FROM events
  UNION ALL SELECT 'data_type_consistency', 'kind', count(DISTINCT regexp_matches(event_type, '^[0-9]+$')) = 1,
    CASE WHEN count(DISTINCT regexp_matches(event_type, '^[0-9]+$')) = 1 THEN 100.0 ELSE 50.0 END::DOUBLE FROM events""")
def quality_mixed_types(spark, d):
    """Texts that look like different types fail, by their forms."""
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    events = table(spark, d, "events").select(mixed.alias("mixed"), F.col("event_type").alias("kind"))
    return tk.check_data_quality(events, [tk.DataTypes(by_form=True)]).rules.select("rule_type", "column", "passed", "score")


_SEARCHED = ["l_extendedprice", "l_quantity", "l_partkey"]


@query("quantiles_searched", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.1), 6) AS p10,
  round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.99), 6) AS p99 FROM lineitem""" for c in _SEARCHED))
def quantiles_searched(spark, d):
    """The way that large columns take: brackets from sketches, searched until their values can be counted in tasks."""
    found = quantiles(table(spark, d, "lineitem"), _SEARCHED, [0.1, 0.5, 0.99], small=0, listed=20)
    rows = [(c, *[round(q[p], 6) for p in (0.1, 0.5, 0.99)]) for c, q in found.items()]
    return spark.createDataFrame(rows, '"column" string, p10 double, p50 double, p99 double'.replace('"', "`"))
