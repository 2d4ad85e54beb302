"""Filters, order, duplicates, positions and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

import tablekit as tk

from .base import HOLED, I, holed_events, indexed, query, scratch_path, table


@query("filter_and", """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
  WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_totalprice <= 300000""")
def filter_and(spark, d):
    kept = tk.filter_rows(table(spark, d, "orders"), [
        ("o_orderstatus", "==", "O"), ("o_totalprice", ">", 100000.0), ("o_totalprice", "<=", 300000.0),
    ])
    return tk.select_columns(kept, ["o_orderkey", "o_totalprice", "o_orderpriority"])


@query("filter_or", """SELECT o_orderkey, o_totalprice FROM orders
  WHERE o_totalprice < 5000 OR o_totalprice >= 490000 OR o_orderpriority = '1-URGENT'""")
def filter_or(spark, d):
    kept = tk.filter_rows(table(spark, d, "orders"), [
        {"column": "o_totalprice", "operator": "<", "value": 5000.0},
        {"column": "o_totalprice", "operator": ">=", "value": 490000.0},
        {"column": "o_orderpriority", "operator": "=", "value": "1-URGENT"},
    ], mode="or")
    return tk.select_columns(kept, ["o_orderkey", "o_totalprice"])


@query("filter_not_equal_nulls", f"SELECT event_id, event_type FROM {HOLED} WHERE event_type IS DISTINCT FROM 'view'")
def filter_not_equal_nulls(spark, d):
    return tk.filter_rows(holed_events(spark, d), [("event_type", "!=", "view")]).select("event_id", "event_type")


@query("filter_null_checks", f"""SELECT event_id FROM {HOLED}
  WHERE value IS NULL AND event_type IS NOT NULL""")
def filter_null_checks(spark, d):
    kept = tk.filter_rows(holed_events(spark, d), [("value", "is_null"), ("event_type", "is_not_null")])
    return kept.select("event_id")


@query("filter_text", """SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'b[lo]+')
  AND NOT regexp_matches(p_name, '^red') AND (starts_with(p_type, 'S') OR suffix(p_type, 'MY'))""")
def filter_text(spark, d):
    part = table(spark, d, "part")
    both = tk.predicate(part, [("p_name", "contains", "b[lo]+"), ("p_name", "not_contains", "^red")])
    either = tk.predicate(part, [("p_type", "starts_with", "S"), ("p_type", "ends_with", "MY")], "or")
    return part.filter(both & either).select("p_partkey", "p_name")


@query("filter_text_documents", """SELECT doc_id, n_chars FROM documents
  WHERE regexp_matches(text, 'http|@|[0-9]{4}') AND NOT regexp_matches(text, 'Lorem')""")
def filter_text_documents(spark, d):
    docs = tk.filter_rows(table(spark, d, "documents"), [
        ("text", "contains", "http|@|[0-9]{4}"), ("text", "not_contains", "Lorem"),
    ])
    return docs.select("doc_id", "n_chars")


@query("filter_membership", f"""SELECT event_id, event_type FROM {HOLED}
  WHERE coalesce(event_type NOT IN ('view', 'click'), true) AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34)""")
def filter_membership(spark, d):
    kept = tk.filter_rows(holed_events(spark, d), [
        ("event_type", "not_in", ["view", "click"]), ("user_id", "in", [1, 2, 3, 5, 8, 13, 21, 34]),
    ])
    return kept.select("event_id", "event_type")


@query("filter_counts", """SELECT count(*)::BIGINT AS rows_before,
  count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS rows_after,
  (count(*) - count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT AS rows_filtered FROM orders""")
def filter_counts(spark, d):
    return tk.filter_counts(table(spark, d, "orders"), [("o_orderstatus", "=", "F")])


@query("sort_topk", f"""SELECT event_id, event_type, value FROM {HOLED}
  ORDER BY event_type ASC NULLS LAST, value DESC NULLS LAST, event_id LIMIT 250""")
def sort_topk(spark, d):
    top = tk.sort_data(holed_events(spark, d), ["event_type", ("value", False)], limit=250)
    return top.select("event_id", "event_type", "value")


@query("sort_renumbered", f"""SELECT event_id, event_type, value,
  row_number() OVER (ORDER BY event_type DESC NULLS LAST, value ASC NULLS LAST, event_id) - 1 AS __row_index__
  FROM {HOLED}""")
def sort_renumbered(spark, d):
    rows = tk.sort_data(holed_events(spark, d), [("event_type", False), "value"], renumbered=True)
    return rows.select("event_id", "event_type", "value", I)


@query("row_index_by_key", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS __row_index__
  FROM orders WHERE o_orderstatus = 'P'""")
def row_index_by_key(spark, d):
    rows = tk.filter_rows(table(spark, d, "orders"), [("o_orderstatus", "=", "P")])
    return tk.with_row_index(rows, "o_orderkey").select("o_orderkey", I)


@query("row_index_by_columns", """SELECT c_custkey,
  row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) - 1 AS __row_index__ FROM customer""")
def row_index_by_columns(spark, d):
    rows = tk.with_row_index(
        table(spark, d, "customer"), [F.col("c_mktsegment"), F.col("c_acctbal").desc(), F.col("c_custkey")]
    )
    return rows.select("c_custkey", I)


@query("row_index_of_files", "SELECT event_id AS __row_index__, event_id, user_id FROM events")
def row_index_of_files(spark, d):
    return indexed(spark, d, "events").select(I, "event_id", "user_id")


_FIRST = """SELECT event_id AS __row_index__, event_id, user_id, event_type, value FROM {0}
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {1}) = 1"""


@query("dedupe_first", _FIRST.format(HOLED, "ASC"))
def dedupe_first(spark, d):
    return tk.remove_duplicates(holed_events(spark, d), ["user_id", "event_type"])


@query("dedupe_last", _FIRST.format(HOLED, "DESC"))
def dedupe_last(spark, d):
    return tk.remove_duplicates(holed_events(spark, d), ["user_id", "event_type"], keep="last")


@query("dedupe_none", """SELECT event_id, user_id, event_type, value FROM events
  QUALIFY count(*) OVER (PARTITION BY user_id, event_type, value) = 1""")
def dedupe_none(spark, d):
    events = indexed(spark, d, "events").select(I, "event_id", "user_id", "event_type", "value")
    return tk.remove_duplicates(events, ["user_id", "event_type", "value"], keep="none").drop(I)


@query("dedupe_documents", """SELECT doc_id, lang, source, n_chars FROM documents
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedupe_documents(spark, d):
    docs = tk.remove_duplicates(indexed(spark, d, "documents"), ["text"])
    return docs.select("doc_id", "lang", "source", "n_chars")


@query("dedupe_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM orders")
def dedupe_rows(spark, d):
    return tk.remove_duplicates(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))


@query("dedupe_hashed", """SELECT o_orderkey AS __row_index__, o_custkey, o_orderpriority, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1""")
def dedupe_hashed(spark, d):
    """The way of many repeated keys: a bitmap lets rows with unique hashes pass, the others meet in a salted join."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias(I), "o_custkey", "o_orderpriority", "o_totalprice")
    return tk.remove_duplicates(orders, ["o_custkey", "o_orderpriority"], broadcast_rows=0)


@query("duplicate_count", """SELECT count(*)::BIGINT AS rows,
  (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS duplicates FROM lineitem""")
def duplicate_count(spark, d):
    return tk.duplicate_count(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _addresses(orders):
    """One address per order of one priority, some outside the table."""
    picked = orders.filter("o_orderpriority = '1-URGENT'")
    column = F.element_at(F.array(*[F.lit(c) for c in (
        "o_custkey", "o_totalprice", "o_orderstatus", "o_nothing")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    row = F.when(F.col("o_orderkey") % 9 == 0, -F.col("o_orderkey") - 1).otherwise(F.col(I))
    return picked.select(row.alias(I), column.alias("column"))


_ADDRESSES = """(SELECT CASE WHEN o_orderkey % 9 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS r,
  ['o_custkey', 'o_totalprice', 'o_orderstatus', 'o_nothing'][o_orderkey % 4 + 1] AS c
  FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("lookup_cells", f"""SELECT r AS __row_index__, c AS "column",
  CASE c WHEN 'o_orderstatus' THEN 'string' WHEN 'o_custkey' THEN 'bigint' ELSE 'double' END AS type,
  CASE c WHEN 'o_orderstatus' THEN o_orderstatus WHEN 'o_custkey' THEN o_custkey::VARCHAR
    ELSE round(o_totalprice, 2)::DECIMAL(18, 2)::VARCHAR END AS value
  FROM {_ADDRESSES} JOIN orders ON o_orderkey = r WHERE c <> 'o_nothing'""")
def lookup_cells(spark, d):
    orders = indexed(spark, d, "orders")
    cells = tk.lookup_cells(orders, _addresses(orders))
    money = F.col("value").try_cast("double").cast("decimal(18,2)").cast("string")
    return cells.withColumn("value", F.when(F.col("column") == "o_totalprice", money).otherwise(F.col("value")))


@query("bad_addresses", f"""SELECT r AS __row_index__, c AS "column",
  CASE WHEN r < 0 THEN 'row out of range' ELSE 'column not found' END AS reason
  FROM {_ADDRESSES} WHERE r < 0 OR c = 'o_nothing'""")
def bad_addresses(spark, d):
    orders = indexed(spark, d, "orders")
    return tk.bad_addresses(orders, _addresses(orders))


@query("lookup_rows", """SELECT o_orderkey AS __row_index__, o_custkey, o_totalprice FROM orders
  WHERE o_orderkey IN (SELECT user_id * 7 FROM events WHERE event_type = 'error')""")
def lookup_rows(spark, d):
    wanted = table(spark, d, "events").filter("event_type = 'error'").select((F.col("user_id") * 7).alias(I))
    return tk.lookup_rows(indexed(spark, d, "orders"), wanted, ["o_custkey", "o_totalprice"])


@query("column_slice", """SELECT o_orderkey AS __row_index__, o_totalprice FROM orders
  WHERE o_orderkey >= 10""")
def column_slice(spark, d):
    return tk.column_slice(indexed(spark, d, "orders"), "o_totalprice", 10)


def _patches(orders):
    """Two patches per order with status F: a price and a status; every tenth price does not parse."""
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("unknown")).otherwise((F.col("o_orderkey") * 2).cast("string"))
    cells = F.array(
        F.struct(F.lit("o_totalprice").alias("column"), price.alias("value")),
        F.struct(F.lit("o_orderstatus").alias("column"), F.lit("X").alias("value")),
    )
    return orders.filter("o_orderstatus = 'F'").select(I, F.explode(cells).alias("x")).select(I, "x.*")


@query("patch_cells", """SELECT o_orderkey,
  CASE WHEN o_orderstatus <> 'F' THEN o_totalprice WHEN o_orderkey % 10 = 0 THEN NULL
    ELSE (o_orderkey * 2)::DOUBLE END AS o_totalprice,
  CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def patch_cells(spark, d):
    orders = indexed(spark, d, "orders")
    return tk.patch_cells(orders, _patches(orders)).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("patch_report", """SELECT o_orderkey AS __row_index__, 'o_orderstatus' AS "column", 'F' AS old_value, 'X' AS new_value
  FROM orders WHERE o_orderstatus = 'F'""")
def patch_report(spark, d):
    orders = indexed(spark, d, "orders")
    return tk.patch_report(orders, _patches(orders)).filter(F.col("column") == "o_orderstatus")


@query("insert_rows", """SELECT __row_index__, c_custkey, c_name, c_mktsegment FROM (
  SELECT CASE WHEN c_custkey >= 40 THEN c_custkey + (SELECT count(*) FROM supplier) ELSE c_custkey END AS __row_index__,
    c_custkey, c_name, c_mktsegment FROM customer
  UNION ALL SELECT s_suppkey + 40, s_suppkey, s_name, NULL FROM supplier)""")
def insert_rows(spark, d):
    new = indexed(spark, d, "supplier").select(I, F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    customers = indexed(spark, d, "customer").select(I, "c_custkey", "c_name", "c_mktsegment")
    return tk.insert_rows(customers, new, at=40)


@query("append_rows_from_json", """SELECT event_id AS __row_index__, event_id, event_type FROM events
  UNION ALL SELECT (SELECT count(*) FROM events) + event_id, event_id, NULL FROM events""")
def append_rows_from_json(spark, d):
    events = indexed(spark, d, "events").select(I, "event_id", "event_type")
    lines = events.select(I, F.to_json(F.struct("event_id")).alias("json"))
    return tk.insert_rows(events, tk.rows_from_json(lines, events))


@query("delete_rows", """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __row_index__, o_orderkey FROM orders
  WHERE o_orderkey NOT IN (SELECT user_id FROM events)""")
def delete_rows(spark, d):
    gone = table(spark, d, "events").select(F.col("user_id").alias(I)).distinct()
    return tk.delete_rows(indexed(spark, d, "orders").select(I, "o_orderkey"), gone)


@query("delete_listed_rows", """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __row_index__, o_orderkey FROM orders
  WHERE o_orderkey NOT IN (0, 3, 4, 100, 149)""")
def delete_listed_rows(spark, d):
    return tk.delete_rows(indexed(spark, d, "orders").select(I, "o_orderkey"), [3, 0, 4, 149, 100])


@query("find_cells", """SELECT p_partkey AS __row_index__, 'p_size' AS "column", '7' AS value FROM part WHERE p_size = 7
  UNION ALL SELECT p_partkey, 'p_partkey', '7' FROM part WHERE p_partkey = 7""")
def find_cells(spark, d):
    return tk.find_cells_with_value(indexed(spark, d, "part"), 7)


@query("find_cells_missing", f"""SELECT event_id AS __row_index__, 'value' AS "column", NULL::VARCHAR AS value FROM {HOLED}
  WHERE value IS NULL UNION ALL SELECT event_id, 'event_type', NULL FROM {HOLED} WHERE event_type IS NULL""")
def find_cells_missing(spark, d):
    return tk.find_cells_with_value(holed_events(spark, d), None)


@query("find_cells_substring", """SELECT p_partkey AS __row_index__, 'p_name' AS "column", p_name AS value FROM part
  WHERE regexp_matches(p_name, 'RED|ring', 'i')
  UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE regexp_matches(p_type, 'RED|ring', 'i')""")
def find_cells_substring(spark, d):
    return tk.find_cells_with_value(indexed(spark, d, "part"), "RED|ring", ["p_name", "p_type"], exact_match=False)


@query("inspect_around", """SELECT o_orderkey AS __row_index__, o_custkey, o_orderstatus, o_totalprice FROM orders
  WHERE o_orderkey BETWEEN 96 AND 104""")
def inspect_around(spark, d):
    return tk.inspect_data_around(indexed(spark, d, "orders"), 100, "o_orderstatus", 4).select(
        I, "o_custkey", "o_orderstatus", "o_totalprice"
    )


@query("inspect_around_many", """SELECT a.o_orderkey AS centre, b.o_orderkey AS __row_index__, b.o_custkey, b.o_orderstatus
  FROM orders a JOIN orders b ON b.o_orderkey BETWEEN a.o_orderkey - 1 AND a.o_orderkey + 1
  WHERE a.o_totalprice > 495000""")
def inspect_around_many(spark, d):
    orders = indexed(spark, d, "orders")
    centres = orders.filter("o_totalprice > 495000").select(F.col(I).alias("centre"))
    return tk.inspect_data_around_many(orders, centres, "o_custkey", 1).select(
        "centre", I, "o_custkey", "o_orderstatus"
    )


@query("preview", """SELECT o_orderkey AS __row_index__, o_orderkey, o_orderstatus,
  (SELECT count(*) FROM orders)::BIGINT AS total_rows, 2::BIGINT AS total_columns, true AS truncated
  FROM orders WHERE o_orderkey < 10""")
def preview(spark, d):
    return tk.preview(indexed(spark, d, "orders").select(I, "o_orderkey", "o_orderstatus"), 10)


@query("read_csv_types", """SELECT c_custkey AS __row_index__, c_custkey, c_name,
  CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END::BIGINT AS c_nationkey, c_acctbal,
  c_acctbal > 0 AS in_credit FROM customer""")
def read_csv_types(spark, d):
    path = scratch_path(spark)
    customers = table(spark, d, "customer").select(
        "c_custkey", "c_name",
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("string")).otherwise(F.lit("N/A")).alias("c_nationkey"),
        "c_acctbal", (F.col("c_acctbal") > 0).alias("in_credit"),
    )
    customers.write.csv(path, header=True)
    back = tk.read_csv(spark, path)
    # numbered by file; the key gives the order of the table
    return tk.with_row_index(back.drop(I), "c_custkey")


@query("read_csv_no_header", """SELECT p_partkey AS "Column_0", p_name AS "Column_1", p_retailprice AS "Column_2" FROM part""")
def read_csv_no_header(spark, d):
    path = scratch_path(spark)
    table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").write.csv(path, sep=";")
    return tk.read_csv(spark, path, delimiter=";", header="none", row_index=False)


@query("read_csv_header_row", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def read_csv_header_row(spark, d):
    path = scratch_path(spark)
    head = spark.createDataFrame([("a comment", "", 0), ("n_nationkey", "n_name", 1)], "a string, b string, k int")
    body = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("a"), F.col("n_name").alias("b"), F.lit(2).alias("k"))
    lines = head.unionByName(body).coalesce(1).sortWithinPartitions("k", "a")
    lines.select("a", "b").write.csv(path)
    return tk.read_csv(spark, path, header="row", header_row=1).drop(I)


