import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tablekit.plans import quantiles as q

PS = [0.0, 0.25, 0.5, 0.75, 1.0]


def check(spark, columns, small, listed):
    n = len(next(iter(columns.values())))
    columns = {c: [None if x is None else float(x) for x in v] for c, v in columns.items()}
    data = [tuple(v[i] for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = q._quantiles(df, list(columns), PS, small=small, listed=listed)[0]
    for c, values in columns.items():
        known = [v for v in values if v is not None and not np.isnan(v)]
        want = np.quantile(known, PS) if known else [None] * len(PS)
        for p, w in zip(PS, want):
            assert got[c][p] == (None if w is None else pytest.approx(w, rel=1e-12, abs=1e-12)), (c, p)


@pytest.mark.parametrize("small,listed", [(10**6, 10), (0, 10**6), (0, 3), (0, 0)])
def test_every_way_to_the_same_quantile(spark, small, listed):
    rng = np.random.default_rng(5)
    skewed = [7.0] * 400 + list(rng.normal(size=200)) + [None] * 10 + [float("nan")] * 5
    check(spark, {
        "normal": list(rng.normal(size=615)), "hot": skewed, "two": [0.0, 1.0] * 307 + [0.0], "none": [None] * 615,
    }, small, listed)


def test_search_inside_brackets(spark, monkeypatch):
    # a coarse sketch leaves wide brackets, so that the search goes several rounds
    monkeypatch.setattr(q, "SKETCH_SIZE", 8)
    monkeypatch.setattr(q, "REACH", 0.02)
    rng = np.random.default_rng(6)
    check(spark, {"u": list(rng.uniform(size=900)), "h": [3.0] * 300 + list(rng.uniform(0, 6, size=600))}, 0, 5)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=30))
def test_random_columns(spark, values):
    values = [None if v is None else float(v) for v in values]
    check(spark, {"x": values}, 0, 2)


def test_long_columns_keep_their_type(spark):
    df = spark.range(1001)
    assert q._quantiles(df, ["id"], [0.5], small=0, listed=2)[0]["id"][0.5] == 500.0


def test_other_aggregates_from_the_first_scan(spark):
    from pyspark.sql import functions as F
    found, more = q.quantiles_and(spark.range(5), ["id"], [0.5], {"sum": F.sum("id"), ("max", "id"): F.max("id")})
    assert found == {"id": {0.5: 2.0}} and more == {"sum": 10, ("max", "id"): 4}
    assert q.quantiles_and(spark.range(5), [], [0.5], {"sum": F.sum("id")}) == ({}, {"sum": 10})
