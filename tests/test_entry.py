"""Every registered query against its SQL text, on the smallest tables, and the shape of its plan."""

import decimal
import math
import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries as all_queries
from registered import QUERIES
from test_plans import plan

duckdb = pytest.importorskip("duckdb")
#: Queries added by optional packages have tests of their own.
queries = lambda: {name: fn for name, fn in all_queries().items() if name in QUERIES}
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def check_plan(text):
    """No pairing of all rows, no Python, no window that orders the whole table in one task."""
    assert "CartesianProduct" not in text and "PythonUDF" not in text and "ArrowEvalPython" not in text
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", text):
        assert not re.match(r"\w+ (ASC|DESC)", spec), spec  # ORDER BY without PARTITION BY


def comparable(table):
    return sorted(table, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, db, name):
    df = queries()[name](spark, DATA)
    check_plan(plan(df))
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    result = db.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(names) == columns
    assert comparable(got) == comparable(want)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0
