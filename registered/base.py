"""Registration and the tables the queries start from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

import tablekit as tk
from tablekit.plans.store import checkpoint_root

QUERIES, SQL = {}, {}
I = tk.INDEX


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def indexed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table with its row index in file order. The files of ``events`` and ``orders`` are in key order."""
    return tk.read_parquet(spark, f"{d}/{name}.parquet")


def holed_events(spark: SparkSession, d: str) -> DataFrame:
    """``events`` with some values and types taken out, since the given tables have no nulls."""
    e = indexed(spark, d, "events")
    return e.select(
        I, "event_id", "user_id",
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


HOLED = """(SELECT event_id AS __row_index__, event_id, user_id,
  CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"""


def scratch_path(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/tablekit/files/{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison with another engine's order of summation."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes
    ])
