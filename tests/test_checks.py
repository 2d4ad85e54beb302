import random

import pytest
from pyspark.sql import functions as F

import tablekit as tk
from conftest import rows
from tablekit.errors import ColumnNotFound, InvalidParameter

I = tk.INDEX


@pytest.fixture()
def members(spark):
    return spark.createDataFrame(
        [(0, 1, "Ann", 30, "a@x.org", "on"), (1, 2, "Bob", -5, "bad", "off"), (2, 2, None, 150, None, "on"), (3, 4, "Di", None, "d@x.org", "odd")],
        f"{I} long, id long, name string, age long, email string, status string")


@pytest.mark.parametrize("column,rules,bad", [
    ("name", {"nullable": False}, [2]), ("id", {"unique": True}, [1, 2]), ("age", {"equal_to": 30}, [1, 2]),
    ("age", {"not_equal_to": 30}, [0]), ("age", {"greater_than": 30}, [0, 1]), ("age", {"greater_than_or_equal_to": 30}, [1]),
    ("age", {"less_than": 150}, [2]), ("age", {"less_than_or_equal_to": 30}, [2]), ("age", {"in_range": {"min": 0, "max": 120}}, [1, 2]),
    ("age", {"in_range": {"min": 0}}, [1]), ("status", {"isin": ["on", "off"]}, [3]), ("status", {"notin": ["odd"]}, [3]),
    ("email", {"str_contains": "@"}, [1]), ("email", {"str_endswith": "org"}, [1]), ("name", {"str_startswith": "A"}, [1, 3]),
    ("name", {"str_matches": "[AB]"}, [3]), ("email", {"str_matches": "x"}, [0, 1, 3]), ("name", {"str_length": {"min": 3, "max": 5}}, [3]),
    ("name", {"str_length": {"max": 2}}, [0, 1]), ("age", {"greater_than": 0, "ignore_na": False}, [1, 3]), ("name", {}, []),
])
def test_each_rule(members, column, rules, bad):
    found = tk.schema_violations(members, {column: rules})
    assert sorted(r[I] for r in found.collect()) == bad
    checks = tk.schema_checks(members, {column: rules}).collect()
    assert sum(r["violations"] for r in checks) == len(bad)


def test_violation_rows_and_summary(members):
    schema = {"age": tk.ColumnRules(greater_than=0, less_than=100, nullable=False), "status": {"isin": ["on", "off", "odd"]}, "city": {}}
    got = rows(tk.schema_violations(members, schema), "column", "check_name", I, "failure_case")
    assert got == [("age", "greater_than", 1, "-5"), ("age", "less_than", 2, "150"), ("age", "not_nullable", 3, None), ("city", "column_missing", None, None)]
    assert tuple(tk.schema_summary(members, schema).first()) == (False, 3, 1, 2, "city", "email,id,name", 4)
    assert tk.schema_summary(members, {"status": {}}).first()["valid"] is True
    assert tk.schema_violations(members, schema, max_errors=2).count() == 2


def test_rule_errors(members):
    for rules in ({"between": 1}, {"in_range": {}}, {"str_length": {"low": 1}}):
        with pytest.raises(InvalidParameter):
            tk.schema_violations(members, {"age": rules})
    with pytest.raises(InvalidParameter):
        tk.schema_violations(members, {"name": {"greater_than": 3}})
    with pytest.raises(InvalidParameter):
        tk.schema_violations(members, {"name": {"str_matches": "("}})


def test_unique_with_a_hot_value(spark):
    df = spark.range(900).select(F.col("id").alias(I), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    found = [r[I] for r in tk.schema_violations(df, {"k": {"unique": True}}).collect()]
    assert sorted(found) == list(range(0, 900, 3))


def scores(report):
    return {(r["rule_type"], r["column"]): (r["passed"], r["score"]) for r in report.rules.collect()}


def test_quality_of_a_clean_table(spark):
    df = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 3, "c")], f"{I} long, id long, s string")
    report = tk.check_data_quality(df)
    assert tuple(report.overall.first())[:4] == (100.0, 6, 0, 0)


def test_quality_rules(spark):
    data = [(i, float(i % 4), None if i % 3 == 0 else "12", "2024-01-02", "2024-01-01" if i == 0 else "2024-01-03") for i in range(12)]
    df = spark.createDataFrame(data, f"{I} long, v double, s string, a string, b string").withColumns(
        {"a": F.col("a").cast("timestamp"), "b": F.col("b").cast("timestamp")})
    report = tk.check_data_quality(df, [
        tk.Completeness(0.9, ["s", "v"]), tk.Duplicates(columns=["v"]), tk.Uniqueness("v"), tk.Uniqueness("v", expected_unique=False),
        tk.DataTypes(), tk.Outliers(), tk.Consistency(), tk.Consistency(["v", "s"])])
    got = scores(report)
    assert got["completeness", "s"] == (False, 66.67) and got["completeness", "v"] == (True, 100.0)
    assert got["duplicates", None] == (False, 33.33) and got["uniqueness", "v"][1] in (33.33, 100.0)
    assert got["data_type_consistency", "s"] == (True, 100.0) and got["outliers", "v"] == (True, 100.0)
    assert got["consistency", None] == (False, 91.67)
    failed = {r["rule_type"]: r for r in report.rules.filter(~F.col("passed")).collect()}
    assert failed["completeness"]["severity"] == "medium" and failed["completeness"]["affected_rows"] == 4
    assert failed["duplicates"]["severity"] == "high" and failed["consistency"]["affected_rows"] == 1
    overall = report.overall.first()
    parts = [200 / 3, 100, 100 / 3, 100 / 3, 100, 100, 100, 100, 100, 100, 1100 / 12]
    assert overall["overall_score"] == round(sum(parts) / len(parts), 2)
    assert "holds numbers as text" in overall["recommendations"] and overall["failed_rules"] == 4


def test_quality_of_an_empty_table_and_no_rules(people):
    assert tk.check_data_quality(people.limit(0)).overall.first()["overall_score"] == 100.0
    assert tk.check_data_quality(people, []).overall.first()["overall_score"] == 100.0
    half = tk.check_data_quality(people, [tk.Completeness(columns=["note"])], thresholds=tk.Thresholds(low_completeness=0.7))
    assert half.rules.first()["severity"] == "high"


def test_statistical_anomalies(spark):
    values = [10.0, 11.0, 12.0, 11.5, 10.5, 11.2, 10.9, 11.1, 12.2, 95.0, None]
    df = spark.createDataFrame(list(enumerate(values)), f"{I} long, v double").withColumn("flat", F.lit(1))
    assert rows(tk.statistical_anomalies(df), "column", I, "value") == [("v", 9, "95.0")]
    report = tk.find_anomalies(df)
    assert tuple(report.summary.first())[:2] == (1, 1)
    row = {r["column"]: r for r in report.by_method.filter("method = 'statistical'").collect()}["v"]
    assert row["anomaly_count"] == 1 and row["upper_bound"] < 95


def test_pattern_anomalies(spark):
    # 12 frequent upper-case labels, one rare value, one frequent value in lower case
    labels = [f"LABEL{i % 12}" for i in range(6000)] + ["quiet"] * 40 + ["ONCE"]
    random.Random(1).shuffle(labels)
    df = spark.createDataFrame(list(enumerate(labels)), f"{I} long, label string").repartition(3)
    found = {r[I] for r in tk.pattern_anomalies(df).collect()}
    assert found == {i for i, s in enumerate(labels) if s in ("quiet", "ONCE")}
    report = tk.find_anomalies(df, methods=["pattern"])
    row = report.by_method.first()
    assert (row["expected_pattern"], row["anomaly_count"]) == ("uppercase", 41)
    # without a rare value the letter case is not looked at
    assert tk.pattern_anomalies(df.filter("label <> 'ONCE'")).count() == 0
    assert tk.pattern_anomalies(df, sensitivity=1.0).count() == 0


def test_missing_anomalies(spark):
    cells = lambda i: (i, None if i in (3, 4) else 1.0, None if i % 5 == 0 else 1.0, None if i % 2 else 1.0, None if i == 7 else 1.0, None)
    df = spark.createDataFrame([cells(i) for i in range(40)], f"{I} long, pair double, fifth double, half double, one double, none double")
    got = rows(tk.missing_anomalies(df), "column", "missing_count", "missing_ratio", "sequential_clusters", "pattern")
    # two adjacent nulls: one cluster > 0.3 * 2; a fifth of the rows: suspicious share; half, one, all: neither
    assert got == [("fifth", 8, 0.2, 0, "random"), ("pair", 2, 0.05, 1, "clustered")]


def test_anomalies_by_column_and_errors(spark):
    rng = random.Random(4)
    data = [(i, None if i % 5 == 0 else 1000.0 if i == 1 else rng.random()) for i in range(100)]
    df = spark.createDataFrame(data, f"{I} long, v double")
    report = tk.find_anomalies(df)
    assert rows(report.by_method, "method", "column") == [("missing", "v"), ("statistical", "v")]
    assert rows(report.by_column, "method", "column") == [("statistical", "v")]
    assert report.summary.first()["affected_columns"] == "v"
    with pytest.raises(ColumnNotFound):
        tk.find_anomalies(df, ["nope"])
    with pytest.raises(InvalidParameter):
        tk.find_anomalies(df, methods=["magic"])
    with pytest.raises(InvalidParameter):
        tk.find_anomalies(df, sensitivity=2)
    clean = tk.find_anomalies(spark.createDataFrame([(0, 1), (1, 2), (2, 3)], f"{I} long, n long"))
    assert tuple(clean.summary.first()) == (0, 0, "") and clean.by_method.count() == 0
