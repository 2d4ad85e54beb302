"""Plans: what reaches the scan and how often a table is shuffled."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import tablekit as tk
from __spark_entry__ import queries
from tablekit.errors import InvalidParameter

I = tk.INDEX
DATA = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return re.sub(r"#\d+L?", "", out.getvalue())


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet")


def test_filters_and_columns_reach_the_scan(orders):
    kept = tk.filter_rows(orders, [("o_totalprice", ">", 5.0), ("o_orderstatus", "!=", "F"), ("o_custkey", "in", [1, 2])])
    text = plan(kept.select("o_orderkey"), "formatted")
    assert "GreaterThan(o_totalprice,5.0)" in text and "In(o_custkey, [1,2])" in text
    assert "Or(IsNull(o_orderstatus),Not(EqualTo(o_orderstatus,F)))" in text
    assert "o_orderdate" not in text.split("ReadSchema")[1] and "Exchange" not in text


def test_outlier_bounds_reach_the_scan(spark):
    text = plan(tk.detect_outliers(tk.read_parquet(spark, f"{DATA}/events.parquet"), ["value", "user_id"]))
    assert re.search(r"PushedFilters: \[Or\(.*LessThan\(value", text) and "LessThan(user_id" in text and "Exchange" not in text


@pytest.mark.parametrize("name,shuffles", [
    ("filter_and", 0), ("update_map", 0), ("text_replace", 0), ("validate_violations", 0), ("find_cells", 0), ("insert_rows", 1),  # the new rows only
    ("delete_listed_rows", 0), ("group_stats", 1), ("dedupe_first", 0),  # its hashes are grouped in a job of their own
    ("fill_forward", 1), ("row_index_by_key", 1), ("profile", 0),  # its histogram is collected, a row per column
])
def test_number_of_shuffles(spark, name, shuffles):
    text = plan(queries()[name](spark, DATA))
    assert len(re.findall(r"\bExchange ", text)) == shuffles, text


def test_blocks_cost_one_shuffle_of_the_table(spark, people):
    """Across blocks the table is shuffled on the block once, for the window and for the join with the block sums."""
    wide = people.withColumn("payload", F.repeat("name", 50))
    for df in (tk.renumber(wide, bits=1), tk.fill_missing_values(wide, "forward", columns=["score"], block_bits=1)):
        table_shuffles = [x for x in plan(df).split("Exchange hashpartitioning") if "payload" in x.split("Exchange")[0].split("LogicalRDD")[0].split("Scan")[0]]
        assert len(table_shuffles) <= 2, plan(df)


def test_positions_open_only_their_files(spark, tmp_path):
    path = f"{tmp_path}/five"
    spark.range(0, 50, 1, 5).select("id", F.concat(F.lit("v"), "id").alias("v")).write.parquet(path)
    df = tk.read_parquet(spark, path)

    def files(found):
        rows = found.collect()
        # The number of files that the scan has read.
        read = found._jdf.queryExecution().executedPlan().collectLeaves()
        return rows, sum(read.apply(k).metrics().get("numFiles").get().value() for k in range(read.size()))

    rows, read = files(tk.lookup_rows(df, [12, 13]))
    assert sorted(tuple(r) for r in rows) == [(12, 12, "v12"), (13, 13, "v13")] and read == 1
    rows, read = files(tk.column_slice(df, "v", 18, 22))
    assert sorted(tuple(r) for r in rows) == [(k, f"v{k}") for k in range(18, 22)] and read == 2
    rows, read = files(tk.inspect_data_around(df, 45, "v", 2))
    assert sorted(r[I] for r in rows) == [43, 44, 45, 46, 47] and read == 1
    rows, read = files(tk.preview(df, 3))
    assert sorted(r["id"] for r in rows) == [0, 1, 2] and {r["total_rows"] for r in rows} == {50} and read == 1
    assert tk.lookup_rows(df, [70, -1]).count() == 0 and tk.column_slice(df, "v", 48).count() == 2
    assert tk.lookup_rows(df.filter("id > 12"), [12, 13]).count() == 1  # a derived table has no files of its own
    with pytest.raises(InvalidParameter):
        tk.column_slice(df, "v", 50)


def test_partitions_follow_written_sizes(spark, monkeypatch):
    from tablekit.plans import order

    monkeypatch.setattr(order, "PART_BYTES", 4096)
    few = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    numbers = [order._sized(order.keep(few.limit(n)))[1] for n in (30, 1000, 3000)]
    assert numbers[0] == 5 < numbers[1] < numbers[2]
    joined = few.join(few.withColumnRenamed("s", "t"), "id")  # the planner multiplies
    assert order._sized(joined)[1] < 4 * numbers[2]
    got = tk.with_row_index(joined.select("id", "t"), [F.col("t").desc()])
    assert got.agg(F.count_distinct(I), F.max(I)).first() == (3000, 2999)
