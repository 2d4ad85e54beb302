"""Projection, derived columns, casts, updates and text."""

from __future__ import annotations

from pyspark.sql import functions as F

import tablekit as tk
from tablekit import math as m, text as tx

from .base import HOLED, I, holed_events, indexed, query, table


@query("project_rename_drop", """SELECT c_custkey AS id, c_name, c_acctbal AS balance, 'retail' AS channel,
  round(c_acctbal * 2, 2) AS doubled FROM customer""")
def project_rename_drop(spark, d):
    c = tk.remove_columns(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])
    c = tk.rename_columns(c, {"c_custkey": "id", "c_acctbal": "balance"})
    c = tk.add_column(c, "channel", "retail")
    c = tk.add_column(c, "doubled", formula="round(balance * 2, 2)")
    return tk.select_columns(c, ["id", "c_name", "balance", "channel", "doubled"])


@query("add_column_values", "SELECT o_orderkey AS __row_index__, o_orderkey, o_custkey % 10 AS bucket FROM orders")
def add_column_values(spark, d):
    orders = indexed(spark, d, "orders")
    values = orders.select(I, (F.col("o_custkey") % 10).alias("value"))
    return tk.add_column_values(orders.select(I, "o_orderkey"), "bucket", values)


@query("derive_arithmetic", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  l_extendedprice / l_quantity AS unit,
  CASE WHEN l_linenumber > 1 THEN (l_extendedprice - 50000) / (l_linenumber - 1)
    WHEN l_extendedprice > 50000 THEN 'Infinity'::DOUBLE WHEN l_extendedprice < 50000 THEN '-Infinity'::DOUBLE END AS ratio,
  floor(l_extendedprice / -7) AS steps,
  round(l_extendedprice - (-7) * floor(l_extendedprice / -7), 6) AS remainder,
  round(pow(l_quantity, 2), 4) AS squared, abs(l_quantity - 25) AS distance,
  greatest(l_quantity, l_linenumber) AS larger, least(l_quantity, l_linenumber) AS smaller,
  round_even(l_quantity / 2, 0) AS half FROM lineitem""")
def derive_arithmetic(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        m.true_div("l_extendedprice", "l_quantity").alias("unit"),
        m.true_div(F.col("l_extendedprice") - 50000, F.col("l_linenumber") - 1).alias("ratio"),
        m.floor_div("l_extendedprice", F.lit(-7)).alias("steps"),
        F.round(m.modulo("l_extendedprice", F.lit(-7)), 6).alias("remainder"),
        F.round(m.power("l_quantity", F.lit(2)), 4).alias("squared"), F.abs(F.col("l_quantity") - 25).alias("distance"),
        m.largest("l_quantity", F.col("l_linenumber").cast("double")).alias("larger"),
        m.smallest("l_quantity", F.col("l_linenumber").cast("double")).alias("smaller"),
        m.round_even(F.col("l_quantity") / 2).alias("half"),
    )


@query("derive_division_by_zero", """SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber = 2 THEN 2 ELSE 0 END AS sign FROM lineitem""")
def derive_division_by_zero(spark, d):
    x = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice"))\
        .when(F.col("l_linenumber") == 2, -F.col("l_extendedprice")).otherwise(F.lit(0.0))
    q = m.true_div(kind, F.lit(0))
    sign = F.when(q == float("inf"), 1).when(q == float("-inf"), 2).when(q.isNull(), 0)
    return x.select("l_orderkey", "l_linenumber", "l_extendedprice", sign.alias("sign"))


@query("derive_functions", """SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(exp(p_size / 10.0), 6) AS grown,
  round(ln(p_retailprice), 6) AS log_e, round(log10(p_retailprice), 6) AS log_10,
  round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 6) AS t,
  round(asin(p_size / 51.0), 6) AS as_, round(acos(p_size / 51.0), 6) AS ac, round(atan(p_size), 6) AS at,
  round((exp(p_size / 10.0) - exp(-p_size / 10.0)) / 2, 6) AS sh,
  round((exp(p_size / 10.0) + exp(-p_size / 10.0)) / 2, 6) AS ch,
  round(1 - 2 / (exp(p_size / 5.0) + 1), 6) AS th,
  round(degrees(p_size), 6) AS deg, round(radians(p_size), 6) AS rad, floor(p_retailprice / 3)::BIGINT AS down,
  ceil(p_retailprice / 3)::BIGINT AS up, trunc(-p_retailprice / 3)::BIGINT AS cut,
  round(pi() * p_size, 6) AS round_, round(exp(1) * p_size, 6) AS e_,
  (p_size::BIGINT << 2) AS sl, (p_size::BIGINT >> 1) AS sr, (p_size & 6)::BIGINT AS band, (p_size | 6)::BIGINT AS bor,
  xor(p_size, 6)::BIGINT AS bxor, (~p_size)::BIGINT AS bnot, -p_size::BIGINT AS neg FROM part""")
def derive_functions(spark, d):
    p, z = table(spark, d, "part"), F.col("p_size")
    r = lambda c: F.round(c, 6)
    return p.select(
        "p_partkey", r(m.square_root("p_retailprice")).alias("root"), r(F.exp(z / 10.0)).alias("grown"),
        r(m.log("p_retailprice")).alias("log_e"), r(m.log10("p_retailprice")).alias("log_10"),
        r(F.sin(z)).alias("s"), r(F.cos(z)).alias("c"), r(F.tan(z)).alias("t"), r(F.asin(z / 51.0)).alias("as_"),
        r(F.acos(z / 51.0)).alias("ac"), r(F.atan(z)).alias("at"), r(F.sinh(z / 10.0)).alias("sh"),
        r(F.cosh(z / 10.0)).alias("ch"), r(F.tanh(z / 10.0)).alias("th"), r(F.degrees(z)).alias("deg"),
        r(F.radians(z)).alias("rad"), F.floor(F.col("p_retailprice") / 3).alias("down"),
        F.ceil(F.col("p_retailprice") / 3).alias("up"), m.truncate(-F.col("p_retailprice") / 3).alias("cut"),
        r(F.pi() * z).alias("round_"), r(F.e() * z).alias("e_"), m.shift_left("p_size", 2).alias("sl"),
        m.shift_right("p_size", 1).alias("sr"), z.bitwiseAND(6).cast("long").alias("band"),
        z.bitwiseOR(6).cast("long").alias("bor"), z.bitwiseXOR(6).cast("long").alias("bxor"),
        F.bitwise_not(z).cast("long").alias("bnot"), (-z).cast("long").alias("neg"),
    )


@query("derive_booleans", f"""SELECT event_id, coalesce(value > 50, false) AS big, value IS NULL AS none,
  coalesce(event_type IN ('view', 'click'), false) AS seen,
  coalesce(value > 50, false) AND event_type IS NOT NULL AS both_,
  coalesce(value > 50, false) OR event_type IS NULL AS either, NOT coalesce(value > 50, false) AS small FROM {HOLED}""")
def derive_booleans(spark, d):
    e = holed_events(spark, d)
    two_valued = lambda p: F.coalesce(p, F.lit(False))
    big = two_valued(tk.predicate(e, [("value", ">", 50.0)]))
    return e.select(
        "event_id", big.alias("big"), tk.predicate(e, [("value", "is_null")]).alias("none"),
        two_valued(tk.predicate(e, [("event_type", "in", ["view", "click"])])).alias("seen"),
        (big & F.col("event_type").isNotNull()).alias("both_"), (big | F.col("event_type").isNull()).alias("either"),
        (~big).alias("small"),
    )


@query("derive_text", """SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low,
  upper(p_name[1]) || lower(p_name[2:]) AS cap, lower(p_brand[1]) || upper(p_brand[2:]) AS swapped,
  length(p_name)::BIGINT AS n, trim(p_name, 'sr') AS cut, replace(p_name, 'l', 'LL') AS swap,
  regexp_matches(p_name, 'o.t') AS has, starts_with(p_name, 'red') AS head, suffix(p_name, 'et') AS tail,
  p_name || '/' || p_type AS joined FROM part""")
def derive_text(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), tx.capitalize("p_name").alias("cap"),
        tx.swap_case("p_brand").alias("swapped"), tx.text_length("p_name").cast("long").alias("n"),
        tx.strip("p_name", "sr").alias("cut"), tx.replace_literal("p_name", "l", "LL").alias("swap"),
        tx.matches("p_name", "o.t").alias("has"), F.col("p_name").startswith("red").alias("head"),
        F.col("p_name").endswith("et").alias("tail"), F.concat("p_name", F.lit("/"), "p_type").alias("joined"),
    )


@query("derive_whole_column", f"""SELECT event_id, round((value - (SELECT avg(value) FROM {HOLED}))
    / (SELECT stddev_pop(value) FROM {HOLED}), 6) AS z,
  round(value / (SELECT max(value) FROM {HOLED}), 6) AS of_max, (SELECT count(*) FROM {HOLED})::BIGINT AS rows_
  FROM {HOLED}""")
def derive_whole_column(spark, d):
    e = holed_events(spark, d)
    z = (F.col("value") - m.whole_column(e, "value", "mean")) / m.whole_column(e, "value", "std")
    return e.select(
        "event_id", F.round(z, 6).alias("z"),
        F.round(F.col("value") / m.whole_column(e, "value", "max"), 6).alias("of_max"),
        m.whole_column(e, "value", "len").alias("rows_"),
    )


@query("derive_whole_column_sums", f"""SELECT event_id, round(value / (SELECT sum(value) FROM {HOLED}), 9) AS of_sum,
  round(value - (SELECT min(value) FROM {HOLED}), 6) AS above_min, round(value * value / (SELECT var_pop(value) FROM {HOLED}), 6) AS by_var,
  round(value * 2 + 1, 6) AS "twice the value" FROM {HOLED}""")
def derive_whole_column_sums(spark, d):
    """``sum``, ``min`` and ``var`` of a whole column, and a name with blanks in an expression."""
    e = holed_events(spark, d).select("event_id", F.col("value").alias("the value"))
    v, whole = F.col("the value"), {f: m.whole_column(e, "the value", f) for f in ("sum", "min", "var")}
    return tk.add_column(e, "twice the value", formula="round(`the value` * 2 + 1, 6)").select(
        "event_id", F.round(v / whole["sum"], 9).alias("of_sum"), F.round(v - whole["min"], 6).alias("above_min"),
        F.round(v * v / whole["var"], 6).alias("by_var"), "twice the value",
    )


@query("cast_coerce", """SELECT event_id, trunc(TRY_CAST(t AS DOUBLE))::BIGINT AS as_int, TRY_CAST(t AS DOUBLE) AS as_float,
  user_id::VARCHAR AS as_text, user_id <> 0 AS as_bool, strftime(TRY_CAST(w AS TIMESTAMP), '%Y-%m-%d') AS as_day FROM (
  SELECT event_id, user_id, CASE WHEN event_id % 6 = 0 THEN event_type ELSE value::VARCHAR END AS t,
    CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS w FROM events)""")
def cast_coerce(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "user_id",
        F.when(F.col("event_id") % 6 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("t"),
        F.when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("w"),
    )
    e = e.select("event_id", F.col("t").alias("as_int"), F.col("t").alias("as_float"), F.col("user_id").alias("as_text"),
                 F.col("user_id").alias("as_bool"), F.col("w").alias("as_day"))
    for column, dtype in (("as_int", "int"), ("as_float", "float"), ("as_text", "str"), ("as_bool", "bool"), ("as_day", "datetime")):
        e = tk.change_column_type(e, column, dtype)
    return e.withColumn("as_day", F.date_format("as_day", "yyyy-MM-dd"))


@query("cast_raise", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS o_totalprice FROM orders")
def cast_raise(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return tk.change_column_type(orders, "o_totalprice", "int", errors="raise")


@query("update_replace", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END
  AS o_orderstatus FROM orders""")
def update_replace(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return tk.update_column(orders, "o_orderstatus", "replace", pattern="P", replacement="pending")


@query("update_map", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END
  AS o_orderpriority FROM orders""")
def update_map(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return tk.update_column(orders, "o_orderpriority", "map", mapping={"1-URGENT": 1, "2-HIGH": 2})


@query("update_map_table", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, s_name AS l_suppkey
  FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def update_map_table(spark, d):
    names = table(spark, d, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")
    )
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey")
    return tk.map_values(items, "l_suppkey", names)


@query("update_apply", """SELECT p_partkey, upper(p_name) AS p_name, round(p_retailprice * 1.1 + p_size, 4) AS p_retailprice
  FROM part""")
def update_apply(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    part = tk.update_column(part, "p_name", "apply", expression=F.upper)
    part = tk.update_column(part, "p_retailprice", "apply", expression="round(p_retailprice * 1.1D + p_size, 4)")
    return part.drop("p_size")


@query("update_fillna", f"SELECT event_id, coalesce(event_type, 'none') AS event_type, value FROM {HOLED}")
def update_fillna(spark, d):
    e = holed_events(spark, d).select("event_id", "event_type", "value")
    return tk.update_column(e, "event_type", "fillna", value="none")


@query("text_replace", """SELECT page_id, regexp_replace(url, '^https?://([^/]+)/', '\\1:', 'g') AS url FROM pages""")
def text_replace(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return tk.replace_in_column(pages, "url", r"^https?://([^/]+)/", r"\1:")


@query("text_replace_literal", "SELECT page_id, replace(url, '.', '$1') AS url FROM pages")
def text_replace_literal(spark, d):
    return tk.replace_in_column(table(spark, d, "pages").select("page_id", "url"), "url", ".", "$1", regex=False)


@query("text_replace_documents", """SELECT doc_id, length(regexp_replace(text, '[aeiou]+', '', 'g'))::BIGINT AS n,
  md5(regexp_replace(text, '[aeiou]+', '', 'g')) AS h FROM documents""")
def text_replace_documents(spark, d):
    docs = tk.replace_in_column(table(spark, d, "documents").select("doc_id", "text"), "text", "[aeiou]+", "")
    return docs.select("doc_id", tx.text_length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("text_extract", """SELECT page_id, CASE WHEN regexp_matches(url, 'page=([0-9]+)')
  THEN regexp_extract(url, 'page=([0-9]+)', 1) END AS url FROM pages""")
def text_extract(spark, d):
    return tk.extract_from_column(table(spark, d, "pages").select("page_id", "url"), "url", r"page=([0-9]+)")


@query("text_extract_groups", """SELECT page_id, url,
  CASE WHEN regexp_matches(url, '(https)://([a-z.]+)') THEN regexp_extract(url, '(https)://([a-z.]+)', 1) END AS url_extracted_0,
  CASE WHEN regexp_matches(url, '(https)://([a-z.]+)') THEN regexp_extract(url, '(https)://([a-z.]+)', 2) END AS url_extracted_1
  FROM pages""")
def text_extract_groups(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return tk.extract_from_column(pages, "url", r"(?P<scheme>https)://([a-z.]+)", expand=True)


@query("text_split", "SELECT p_partkey, string_split(p_name, ' ')[2] AS p_name FROM part")
def text_split(spark, d):
    return tk.split_column(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", " ", part_index=1)


@query("text_split_columns", """SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS first,
  string_split(p_name, ' ')[2] AS p_name_part_1 FROM part""")
def text_split_columns(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return tk.split_column(part, "p_name", " ", expand_to_columns=True, new_columns=["first"])


@query("text_split_given_width", """SELECT page_id, url, string_split(url, '/')[1] AS url_part_0, string_split(url, '/')[2] AS url_part_1,
  string_split(url, '/')[3] AS url_part_2, string_split(url, '/')[4] AS url_part_3 FROM pages""")
def text_split_given_width(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return tk.split_column(pages, "url", "/", expand_to_columns=True, num_parts=4)


@query("text_case", """SELECT p_partkey,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_name,
  upper(p_type[1]) || lower(p_type[2:]) AS p_type, lower(p_brand) AS p_brand FROM part""")
def text_case(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    part = tk.transform_column_case(part, "p_name", "title")
    part = tk.transform_column_case(part, "p_type", "capitalize")
    return tk.transform_column_case(part, "p_brand", "lower")


@query("text_strip", """SELECT p_partkey, trim(p_name, 'rt ') AS p_name,
  trim(p_type, chr(32) || chr(9) || chr(10)) AS p_type FROM
  (SELECT p_partkey, p_name, chr(9) || ' ' || p_type || chr(10) AS p_type FROM part)""")
def text_strip(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("\t "), "p_type", F.lit("\n")).alias("p_type"))
    return tk.strip_column(tk.strip_column(part, "p_name", "rt "), "p_type")


@query("text_rows_changed", """SELECT count(*) FILTER (WHERE regexp_replace(p_name, 'e[dt]$', '', 'g') <> p_name)::BIGINT
  AS rows_affected FROM part""")
def text_rows_changed(spark, d):
    part = table(spark, d, "part")
    return tk.rows_changed(part, F.col("p_name"), F.regexp_replace("p_name", "e[dt]$", ""))
