import pytest
from conftest import rows
from pyspark.sql import functions as F

import tablekit as tk
from tablekit.errors import InvalidParameter
from tablekit.streaming import watch as w

I = tk.INDEX
SCHEMA = {"n": {"less_than": 900, "nullable": False}, "gone": {"nullable": False}}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    spark.range(0, 1000, 1, 4).select(
        F.col("id").alias(I), F.when(F.col("id") % 10 != 0, F.col("id")).alias("n"), F.concat(F.lit("t"), F.col("id") % 50).alias("t"),
        F.when(F.col("id") < 0, 1.0).alias("empty"),
    ).write.parquet(path)
    return path


def streamed(spark, folder, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = w.watch(stream, f"{tmp_path}/kept", SCHEMA).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return f"{tmp_path}/kept"


def test_merged_batches_equal_one_scan(spark, folder, tmp_path):
    path = streamed(spark, folder, tmp_path)
    assert spark.read.parquet(f"{path}/metrics").select("batch").distinct().count() == 4
    got = {r["column"]: r for r in w.stream_metrics(spark, path).collect()}
    whole = spark.read.parquet(folder)
    want = {r["column"]: r for r in tk.get_statistics(whole, ["n"]).collect()}["n"]
    n = got["n"]
    assert (n["rows"], n["nulls"], n["count"], n["completeness"]) == (1000, 100, 900, 0.9)
    assert n["mean"] == pytest.approx(want["mean"]) and n["std"] == pytest.approx(want["std"]) and (n["min"], n["max"]) == (1.0, 999.0)
    for p in ("p25", "p50", "p75"):
        assert abs(n[p] - want[p]) <= 30
    assert got["t"]["distinct"] == 50 and abs(n["distinct"] - 900) <= 30 and got["t"]["mean"] is None
    assert (got["empty"]["count"], got["empty"]["mean"], got["empty"]["p50"], got["empty"]["distinct"]) == (0, None, None, 0)
    one = {r["column"]: r for r in w.merged_metrics(w.batch_metrics(whole)).collect()}
    assert one["n"]["mean"] == pytest.approx(n["mean"]) and one["n"]["std"] == pytest.approx(n["std"])
    checks = rows(w.stream_checks(spark, path), "column", "check_name", "violations")
    assert checks == rows(tk.schema_checks(whole, SCHEMA), "column", "check_name", "violations")


def test_a_batch_that_runs_again_counts_once(spark, folder, tmp_path):
    path = streamed(spark, folder, tmp_path)
    before = w.stream_metrics(spark, path).orderBy("column").collect()
    batch = spark.read.parquet(f"{path}/metrics").where("batch = 2").drop("batch")
    kept = batch.collect()
    spark.createDataFrame(kept, batch.schema).write.mode("overwrite").parquet(f"{path}/metrics/batch=2")
    assert [r["rows"] for r in w.stream_metrics(spark, path).orderBy("column").collect()] == [r["rows"] for r in before]


def test_unique_rules_are_refused(spark, folder):
    with pytest.raises(InvalidParameter):
        w.watch(spark.read.parquet(folder), "/nowhere", {"n": {"unique": True}})


def test_row_wise_operators_on_streams(spark, folder, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    out = tk.filter_rows(tk.replace_values(tk.strip_column(stream, "t", "t"), "t", "7", "seven"), [("n", "<", 100)])
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    whole = spark.read.parquet(folder)
    want = tk.filter_rows(tk.replace_values(tk.strip_column(whole, "t", "t"), "t", "7", "seven"), [("n", "<", 100)])
    assert rows(spark.read.parquet(f"{tmp_path}/out"), I, "t") == rows(want, I, "t")
