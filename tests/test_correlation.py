import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tablekit as tk
from tablekit.errors import ColumnNotFound, InvalidParameter
from tablekit.operators import correlation
from tablekit.plans import joins


def table(spark, n=60, nulls=True, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        a = float(rng.randint(0, 8))
        b = a * 2 + rng.gauss(0, 3)
        c = rng.choice([1.0, 2.0, 2.0, 3.0])
        if nulls and rng.random() < 0.2:
            b = None
        data.append((a, b, c, 5.0))
    return data, spark.createDataFrame(data, "a double, b double, c double, flat double").repartition(4)


def matrix(df, method, **kw):
    return {(r["col1"], r["col2"]): r["r"] for r in tk.get_correlation_matrix(df, method, **kw).collect()}


def tau_b(x, y):
    num = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(list(zip(x, y)), 2):
        sx, sy = (a > c) - (a < c), (b > d) - (b < d)
        num, tx, ty = num + sx * sy, tx + abs(sx), ty + abs(sy)
    return num / math.sqrt(tx * ty) if tx and ty else 0.0


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("nulls", [False, True])
def test_matrix_equals_pandas(spark, method, nulls):
    data, df = table(spark, nulls=nulls)
    want = pd.DataFrame(data, columns=["a", "b", "c", "flat"]).corr(method=method).fillna(0.0)
    got = matrix(df, method)
    assert len(got) == 16
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-9), (x, y)


@pytest.mark.parametrize("seed", [1, 2])
def test_kendall_equals_counting_all_pairs(spark, seed):
    data, df = table(spark, n=45, seed=seed)
    got = matrix(df, "kendall", columns=["a", "b", "c"])
    names = ["a", "b", "c"]
    for i, j in itertools.combinations(range(3), 2):
        complete = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
        assert got[names[i], names[j]] == pytest.approx(tau_b(*zip(*complete)), abs=1e-12)
    assert got["a", "a"] == 1.0


def test_kendall_of_constant_and_tiny_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 2.0, 1.0)], "a double, b double, c double")
    got = matrix(df, "kendall")
    assert got["a", "b"] == 0.0 and got["a", "c"] == 0.0 and got["b", "b"] == 0.0


def test_hot_value_in_spearman_and_kendall(spark):
    # a third of the rows share one value
    rng = random.Random(9)
    data = [(0.0 if i % 3 == 0 else rng.random(), rng.random()) for i in range(150)]
    df = spark.createDataFrame(data, "a double, b double")
    want = pd.DataFrame(data, columns=["a", "b"]).corr(method="spearman").loc["a", "b"]
    assert matrix(df, "spearman")["a", "b"] == pytest.approx(want, abs=1e-9)
    assert matrix(df, "kendall")["a", "b"] == pytest.approx(tau_b(*zip(*data)), abs=1e-12)


def test_threshold_keeps_strong_pairs_and_the_diagonal(spark):
    _, df = table(spark, nulls=False)
    got = matrix(df, "pearson", min_correlation=0.5)
    assert ("a", "a") in got and ("flat", "flat") in got and ("a", "b") in got and ("a", "flat") not in got


def test_errors(spark, people):
    with pytest.raises(InvalidParameter):
        tk.get_correlation_matrix(people, "cosine")
    with pytest.raises(InvalidParameter):
        tk.get_correlation_matrix(people, columns=["age", "name"])
    with pytest.raises(ColumnNotFound):
        tk.get_correlation_matrix(people, columns=["nope"])


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_jobs_do_not_grow_with_the_pairs(spark, method):
    """Columns with different nulls, two and five of them: as many jobs."""
    def jobs(k):
        rows = [tuple(None if (i + c) % 7 == 0 else float((i * (c + 3)) % 11) for c in range(k)) for i in range(60)]
        df = spark.createDataFrame(rows, ", ".join(f"c{c} double" for c in range(k)))
        group = f"{method} {k}"
        spark.sparkContext.setJobGroup(group, group)
        tk.get_correlation_matrix(df, method)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert 0 < jobs(5) <= jobs(2) + 2


def test_ascending_pairs_equal_a_double_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 64, 65, 150):
        rank, weight = rng.permutation(n), rng.integers(1, 5, n)
        want = sum(int(weight[i]) * int(weight[j]) for i in range(n) for j in range(i + 1, n) if rank[i] < rank[j])
        assert correlation.ascending_pairs(rank, weight) == want
        assert correlation.ascending_pairs(rank, weight << 33) == want << 66  # beyond 64 bits


@pytest.mark.parametrize("seed", [1, 2])
def test_kendall_over_a_grid_of_many_ranges(spark, seed):
    """A third of the rows share one x and two fifths one y; two pairs of columns meet in the ranges; the grid is cut again."""
    rng = random.Random(seed)
    data = [(float(0 if rng.random() < 0.33 else rng.randint(-40, 40)), float(rng.randint(0, 25) if rng.random() < 0.6 else 5)) for _ in range(900)]
    cells = correlation._cells(spark.createDataFrame(data, "v0 double, v1 double"), [(0, 1), (1, 0)])
    want = sum((a - c) * (b - d) > 0 for (a, b), (c, d) in itertools.combinations(data, 2))
    for part_cells in (16, 100, 1 << 18):
        assert correlation._concordant(cells, part_cells) == {0: want, 1: want}
    assert correlation._concordant(cells.limit(0)) == {}


def test_kendall_jobs_do_not_grow_with_the_values(spark):
    def jobs(distinct):
        df = spark.range(400).selectExpr(f"(id * 37) % {distinct} + 0.0 AS a", f"(id * 91) % {distinct} + 0.0 AS b")
        group = f"digits {distinct}"
        spark.sparkContext.setJobGroup(group, group)
        tk.get_correlation_matrix(df, "kendall", ["a", "b"])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(397) == jobs(3)


def test_spearman_joins_ranks_once_for_all_columns(spark, monkeypatch):
    joined = []
    real = correlation.lookup_join
    monkeypatch.setattr(correlation, "lookup_join", lambda *a, **k: joined.append(a[2]) or real(*a, **k))
    rng = random.Random(4)
    data = [tuple(rng.randint(0, 9) + 0.0 for _ in range(16)) for _ in range(80)]
    got = matrix(spark.createDataFrame(data, ", ".join(f"c{c} double" for c in range(16))), "spearman")  # 136 sums, two jobs
    assert joined == [["c", "v"]]
    want = pd.DataFrame(data).corr(method="spearman")
    assert all(r == pytest.approx(want.loc[int(x[1:]), int(y[1:])], abs=1e-9) for (x, y), r in got.items())


@pytest.mark.parametrize("method", ["spearman", "kendall"])
@pytest.mark.parametrize("nulls", [False, True])
def test_ranks_from_tasks_of_few_rows(spark, monkeypatch, method, nulls):
    """More groups than a task holds: rows are dealt out first. Zeros of both signs are one value; rows come twice, a quarter of them alike."""
    monkeypatch.setattr(correlation, "TASK_ROWS", 20)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    data, _ = table(spark, nulls=nulls, seed=6)
    data = data * 2 + [(0.0, -0.0, 1.0, 5.0), (-0.0, 0.0, 1.0, 5.0)] * 20
    got = matrix(spark.createDataFrame(data, "a double, b double, c double, flat double").repartition(4), method)
    want = pd.DataFrame(data, columns=["a", "b", "c", "flat"]).corr(method=method) if method == "spearman" else None
    for x, y in itertools.permutations(range(4), 2):
        complete = [(r[x], r[y]) for r in data if r[x] is not None and r[y] is not None]
        r = tau_b(*zip(*complete)) if want is None else want.fillna(0.0).iloc[x, y]
        assert got["abc"[x] if x < 3 else "flat", "abc"[y] if y < 3 else "flat"] == pytest.approx(r, abs=1e-9), (x, y)


def test_groups_of_many_values_meet_in_bounded_tasks(spark):
    """Two hundred values once each and one a thousand times: no task has many of the groups, and the sums are whole."""
    df = spark.range(1200).selectExpr("CASE WHEN id < 200 THEN id + 0.5D ELSE -1.0D END AS v")
    grouped = correlation._grouped(df, lambda rows: rows, ["v"], {"n": F.count(F.lit(1))}, task_rows=20)
    parts = grouped.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("groups")).collect()
    assert len(parts) > 10 and max(r["groups"] for r in parts) < 40
    assert {r["v"]: r["n"] for r in grouped.collect()} == {**{i + 0.5: 1 for i in range(200)}, -1.0: 1000}
