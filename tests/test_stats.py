import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tablekit as tk
from conftest import rows
from tablekit.errors import ColumnNotFound, InvalidParameter
from tablekit.plans.metrics import value_histogram

I = tk.INDEX
STAFF = [
    (0, "Eng", "Ann", 70, 5.0), (1, "Eng", "Bob", 82, None), (2, "Ops", "Cy", 50, 2.0), (3, "Eng", "Di", 91, 7.0),
    (4, None, "Ed", 10, 1.0), (5, "Ops", "Flo", 50, None), (6, "HR", "Gus", 61, None),
]


@pytest.fixture()
def staff(spark):
    return spark.createDataFrame(STAFF, f"{I} long, dept string, name string, pay long, years double").repartition(3)


def test_group_by_aggregate_equals_pandas(staff):
    functions = ["count", "mean", "median", "sum", "min", "max", "std", "var", "first", "last", "nunique"]
    got = tk.group_by_aggregate(staff, ["dept"], {"pay": functions, "years": functions})
    want = pd.DataFrame(STAFF, columns=["i", "dept", "name", "pay", "years"]).groupby("dept")[["pay", "years"]].agg(functions)
    assert got.columns == ["dept", *[f"{c}_{f}" for c in ("pay", "years") for f in functions]]
    found = {r["dept"]: r for r in got.collect()}
    assert set(found) == {"Eng", "Ops", "HR"}
    for dept in found:
        for c in ("pay", "years"):
            for f in functions:
                w = want.loc[dept, (c, f)]
                assert found[dept][f"{c}_{f}"] == (None if pd.isna(w) else pytest.approx(w)), (dept, c, f)


def test_group_medians_of_large_groups(spark):
    rng = np.random.default_rng(2)
    data = [("hot" if i % 3 else "k" + str(i % 2), i % 5, float(np.round(rng.normal(), 2))) for i in range(500)]
    df = spark.createDataFrame(data, "a string, b int, v double").repartition(4)
    want = pd.DataFrame(data, columns=["a", "b", "v"]).groupby(["a", "b"])["v"].median()
    got = tk.group_by_aggregate(df, ["a", "b"], {"v": ["median", "count"]}, distinct_limit=0)
    assert got.columns == ["a", "b", "v_median", "v_count"]
    for r in got.collect():
        assert r["v_median"] == pytest.approx(want[r["a"], r["b"]])


def test_group_sums_beyond_64_bits(spark):
    big = 2**62
    data = [("a", big, big, 1), ("a", big, big, None), ("a", big, -big, 2), ("b", 5, big, 3), ("b", -7, big, 4), ("b", None, -big, 5), ("c", None, None, None)]
    df = spark.createDataFrame(data, "k string, wide long, fits long, small int").coalesce(1)
    got = tk.group_by_aggregate(df, ["k"], {"wide": ["sum", "max"], "fits": "sum", "small": "sum"})
    assert [kind for _, kind in got.dtypes] == ["string", "decimal(38,0)", "bigint", "bigint", "bigint"]
    found = {r["k"]: (int(r["wide_sum"]), r["fits_sum"], r["small_sum"]) for r in got.collect()}
    assert found == {"a": (3 * big, big, 3), "b": (-2, big, 12), "c": (0, 0, 0)}
    low = tk.group_by_aggregate(df.select("k", (-F.col("wide")).alias("v")), ["k"], {"v": "sum"})
    assert {r["k"]: int(r["v_sum"]) for r in low.collect()} == {"a": -3 * big, "b": 2, "c": 0}


def test_group_errors(staff):
    with pytest.raises(ColumnNotFound):
        tk.group_by_aggregate(staff, ["x"], {"pay": "sum"})
    with pytest.raises(InvalidParameter):
        tk.group_by_aggregate(staff, ["dept"], {"pay": "mad"})
    with pytest.raises(InvalidParameter):
        tk.group_by_aggregate(staff.drop(I), ["dept"], {"pay": "first"})


def test_group_stats_use_the_first_numeric_column(staff):
    got = rows(tk.group_stats(staff, ["dept"]), "dept", "group_key", "count", "mean", "sum", "min", "max")
    assert got == [("Eng", "Eng", 3, 81.0, 243.0, 70.0, 91.0), ("HR", "HR", 1, 61.0, 61.0, 61.0, 61.0), ("Ops", "Ops", 2, 50.0, 100.0, 50.0, 50.0)]
    assert tk.group_stats(staff.select("dept", "name"), ["dept", "name"]).columns == ["group_key", "dept", "name", "count"]


@pytest.mark.parametrize("exact", [True, False])
def test_statistics(staff, exact):
    got = {r["column"]: r for r in tk.get_statistics(staff, exact=exact).collect()}
    assert set(got) == {"pay", "years"}
    years = pd.Series([r[4] for r in STAFF], dtype=float)
    assert got["years"]["count"] == 4 and got["years"]["mean"] == years.mean() and got["years"]["max"] == 7.0
    assert got["years"]["std"] == pytest.approx(years.std())
    if exact:
        assert got["years"]["p25"] == years.quantile(0.25) and got["years"]["p50"] == years.median()


def test_undefined_statistics_are_zero(spark):
    df = spark.createDataFrame([(3.0, None)], "a double, b double")
    got = {r["column"]: r.asDict() for r in tk.get_statistics(df).collect()}
    assert got["a"]["std"] == 0.0 and got["a"]["p75"] == 3.0
    assert all(got["b"][k] == 0 for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max"))
    assert tk.get_statistics(spark.createDataFrame([("x",)], "s string")).count() == 0


def test_column_statistics(staff, spark):
    got = {r["column"]: r for r in tk.get_column_statistics(staff).collect()}
    assert (got["dept"]["count"], got["dept"]["unique"], got["dept"]["top"], got["dept"]["freq"], got["dept"]["mean"]) == (6, 3, "Eng", 3, None)
    assert (got["pay"]["unique"], got["pay"]["top"], got["pay"]["data_type"]) == (6, None, "int64")
    assert got["name"]["top"] == "Ann"  # ties go to the smallest value
    flags = tk.get_column_statistics(spark.createDataFrame([(True, None), (False, None)], "b boolean, v double"))
    flags = {r["column"]: r for r in flags.collect()}
    assert (flags["b"]["top"], flags["b"]["freq"]) == ("false", 1) and flags["v"]["p50"] is None and flags["v"]["count"] == 0


def test_value_counts(staff):
    got = [tuple(r) for r in tk.value_counts(staff, "dept").collect()]
    assert got == [("Eng", 3, 6, 3), ("Ops", 2, 6, 3), ("HR", 1, 6, 3)]
    assert [r["value"] for r in tk.value_counts(staff, "dept", ascending=True, top_n=1).collect()] == ["HR"]
    assert [r["share"] for r in tk.value_counts(staff, "dept", normalize=True).collect()] == [3 / 6, 2 / 6, 1 / 6]
    assert tk.value_counts(staff, "dept", sort=False).count() == 3


OUT = [(i, float(v), 1.0, None) for i, v in enumerate([10, 11, 12, 13, 14, 12, 11, 13, 12, 500])]


@pytest.fixture()
def readings(spark):
    return spark.createDataFrame(OUT, f"{I} long, v double, flat double, none double").withColumn("n", F.col("v").cast("int"))


def test_outliers(readings):
    v = pd.Series([r[1] for r in OUT])
    q1, q3 = v.quantile(0.25), v.quantile(0.75)
    got = rows(tk.detect_outliers(readings), "column", I, "value", "score")
    score = (500 - (q3 + 1.5 * (q3 - q1))) / (q3 - q1)
    assert got == [("n", 9, 500.0, pytest.approx(score)), ("v", 9, 500.0, pytest.approx(score))]
    z = rows(tk.detect_outliers(readings, ["v", "flat"], "zscore", 2.0), "column", I, "score")
    assert z == [("v", 9, pytest.approx((500 - v.mean()) / v.std()))]
    assert dict(rows(tk.outlier_counts(readings), "column", "outliers")) == {"v": 1, "n": 1, "flat": 0, "none": 0}
    assert tk.detect_outliers(readings, ["none"]).count() == 0 and tk.detect_outliers(readings, ["flat"], "zscore").count() == 0


def test_outlier_cap_nan_and_zero_spread(spark):
    data = [(i, 5.0 if i % 10 else float(i)) for i in range(100)] + [(100, float("nan")), (101, None)]
    df = spark.createDataFrame(data, f"{I} long, v double").repartition(4)
    assert [r[I] for r in tk.detect_outliers(df, per_column_cap=3).orderBy(I).collect()] == [0, 10, 20]
    everything = tk.detect_outliers(df).collect()
    assert len(everything) == 10 and {r["score"] for r in everything} == {0.0}


def test_outlier_errors(readings, spark):
    with pytest.raises(InvalidParameter):
        tk.detect_outliers(readings, method="forest")
    with pytest.raises(InvalidParameter):
        tk.detect_outliers(spark.createDataFrame([(0, "x")], f"{I} long, s string"))
    with pytest.raises(ColumnNotFound):
        tk.detect_outliers(readings, ["nope"])
    with pytest.raises(InvalidParameter):
        tk.detect_outliers(readings, per_column_cap=-1)
    assert tk.detect_outliers(readings, per_column_cap=10**6).count() == tk.detect_outliers(readings).count()


def test_profile(staff, spark):
    got = {r["column"]: r for r in tk.profile_data(staff).collect()}
    assert tuple(got["years"])[1:] == ("float64", 3, 42.86, 4, 57.14, None, 3)   # null is the most frequent value
    assert tuple(got["dept"])[1:] == ("object", 1, 14.29, 3, 42.86, "Eng", 3)
    assert tuple(got["pay"])[1:] == ("int64", 0, 0.0, 6, 85.71, "50", 2)
    quick = {r["column"]: r for r in tk.profile_data(staff, exact=False).collect()}
    assert quick["years"]["null_count"] == 3 and quick["pay"]["unique_count"] == 6
    assert {c: (r["most_frequent"], r["frequency"]) for c, r in quick.items() if c != "name"} == {"years": (None, 3), "dept": ("Eng", 3), "pay": ("50", 2)}
    empty = tk.profile_data(staff.limit(0)).collect()
    assert len(empty) == 4 and {r["null_percentage"] for r in empty} == {0.0}
    nested = spark.createDataFrame([([1, 2], True), ([1, 2], None)], "a array<int>, b boolean")
    assert {r["column"]: r["unique_count"] for r in tk.profile_data(nested).collect()} == {"a": 1, "b": 1}


def test_most_frequent_long_texts(spark):
    """Texts that begin alike are told apart, and no text is shuffled whole."""
    same = "https://www.example.com/the/same/beginning/"
    texts = [same + x for x in ["c", "b", "b", "a", "a"]]
    df = spark.createDataFrame([(t, same + str(k), None, f"{k % 2}.50") for k, t in enumerate(texts)], "often string, once string, never string, short string")
    df = df.withColumn("short", F.col("short").cast("decimal(30,2)"))
    got = {r["column"]: (r["unique_count"], r["most_frequent"], r["frequency"]) for r in tk.profile_data(df).collect()}
    assert got == {"often": (3, same + "a", 2), "once": (5, same + "0", 1), "never": (0, None, 5), "short": (2, "0.50", 3)}
    filled = tk.fill_missing_values(df.unionByName(df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])), "mode", ["often", "short"])
    assert filled.filter(F.col("often") == same + "a").count() == 3
    plan = value_histogram(df, df.columns, ordered=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(c" in plan and all("often" not in line for line in plan.splitlines() if "Exchange" in line)


def test_sketched_most_frequent_stays_in_its_error(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("v"))
    got = tk.profile_data(rows, exact=False).first()
    assert got["most_frequent"] == "hot" and abs(got["frequency"] - 20_000) <= 200_000 / 10_000 * 4


def test_summaries(staff):
    got = {r["column"]: tuple(r)[1:] for r in tk.get_data_summary(staff).collect()}
    assert got["dept"] == ("object", "text", True, 3, 1) and got["pay"] == ("int64", "numeric", False, 6, 0)
    assert tuple(tk.get_table_summary(staff).first()) == (7, 4, 4, 14.29, 2, 2, 0, 0)
    assert tuple(tk.get_table_summary(staff.limit(0)).first())[:4] == (0, 4, 0, 0.0)


def test_value_forms_and_table_checks(spark):
    data = [(i, str(i), f"2024-01-{i + 1:02d}", None, ["1", "x", "2.5", "true"][i % 4], "same") for i in range(12)]
    df = spark.createDataFrame(data, f"{I} long, num string, day string, none string, mix string, same string")
    forms = {r["column"]: r for r in tk.value_forms(df).collect()}
    assert forms["num"]["integer_values"] == 12 and forms["day"]["date_values"] == 12 and forms["none"]["text_values"] == 0
    assert [forms["mix"][f"{k}_values"] for k in ("boolean", "integer", "float", "date", "text")] == [3, 3, 3, 0, 3]
    assert rows(tk.validate_dataframe(df), "severity", "issue", "column") == [
        ("info", "high_cardinality", "day"), ("info", "high_cardinality", "num"), ("info", "potential_datetime", "day"),
        ("warning", "all_null", "none"), ("warning", "mixed_forms", "mix")]
    assert rows(tk.validate_dataframe(df.limit(0)), "issue") == [("empty_table",)]
    twice = df.select("num", F.col("day").alias("num"))
    assert rows(tk.validate_dataframe(twice), "issue", "column") == [("duplicate_column_name", "num")]


def test_fill(people):
    got = lambda *a, **k: [r["score"] for r in tk.fill_missing_values(people, *a, **k).orderBy(I).collect()]
    assert got("mean", columns=["score", "name"]) == pytest.approx([90.5, 71.0, 86.4375, 88.0, 96.25, 86.4375])
    assert got("median") == [90.5, 71.0, 89.25, 88.0, 96.25, 89.25]
    assert got("mode") == [90.5, 71.0, 71.0, 88.0, 96.25, 71.0]
    assert got("fill", 1.5, ["score"]) == [90.5, 71.0, 1.5, 88.0, 96.25, 1.5]
    assert got("forward") == [90.5, 71.0, 71.0, 88.0, 96.25, 96.25] and got("backward")[2] == 88.0
    assert len(got("drop")) == 2 and len(got("drop", columns=["score"])) == 4
    assert [r["note"] for r in tk.fill_missing_values(people, "mode").orderBy(I).collect()] == ["x", "x", "x", "y", "z", "x"]
    assert [r["age"] for r in tk.fill_missing_values(people, "mode", columns=["age"]).orderBy(I).collect()][3] == 27
    for wrong in (("fill", None), ("fill", "x", ["score"]), ("fill", 2.5, ["age"]), ("zigzag",)):
        with pytest.raises(InvalidParameter):
            got(*wrong)
    with pytest.raises(ColumnNotFound):
        got("drop", columns=["nope"])


def test_values_filled(people):
    after = tk.fill_missing_values(people, "forward")
    assert tuple(tk.values_filled(people, after).first()) == (6, 5)
    assert tuple(tk.values_filled(people, tk.fill_missing_values(people, "drop")).first()) == (2, 6)


def test_a_wide_table(spark):
    wide = spark.range(20).select(F.col("id").alias(I), *[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(120)])
    assert tk.get_statistics(wide).count() == 120 and tk.outlier_counts(wide).count() == 120
    assert tuple(tk.get_table_summary(wide).first())[:3] == (20, 120, 0)
    assert tk.fill_missing_values(wide, "drop").count() == 20
