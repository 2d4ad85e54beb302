"""Metrics and schema checks of a stream, kept for each batch and merged on demand.

What is kept of a batch is one row per column: counts, moments, extremes, a sketch of quantiles and one of distinct values; and one row per
check. All of these merge, so that a report over any number of batches reads a few rows for each and never the data again. A batch's rows
are written under its number and replaced if the batch runs again, so that every row counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..errors import InvalidParameter
from ..operators.validate import Schema, schema_checks
from ..plans.columns import INDEX, as_double, data_columns, missing, numeric_columns, value_of
from ..plans.metrics import per_column



def batch_metrics(df: DataFrame, columns: Sequence[str] | None = None, index: str = INDEX) -> DataFrame:
    """The mergeable state of each column: one scan."""
    names = data_columns(df, columns, index)
    numeric = set(numeric_columns(df, names, index)) if names else set()

    def metrics(name: str) -> dict[str, Column]:
        number = as_double(df, name) if name in numeric else F.lit(None).cast("double")
        return {
            "rows": F.count(F.lit(1)), "nulls": F.count_if(missing(df, name)), "mean": F.avg(number), "m2": F.var_pop(number) * F.count(number),
            "min": F.min(number), "max": F.max(number), "quantiles": F.when(F.count(number) > 0, F.kll_sketch_agg_double(number)),
            "distinct": F.hll_sketch_agg(F.xxhash64(F.when(~missing(df, name), value_of(df, name))), F.lit(14)),
        }

    return per_column(df, names, metrics)


def merged_metrics(states: DataFrame) -> DataFrame:
    """Per column: rows, nulls, count, completeness, mean, std (sample), min, p25, p50, p75, max and distinct over all ``states``.

    Counts and extremes are exact, moments up to rounding; quantiles and distinct values are those of sketches (errors near 1 % of the rows, and
    of the number of values). A column without numbers has null for them.
    """
    known = F.col("rows") - F.col("nulls")
    whole = Window.partitionBy("column")  # a row per batch
    centre = F.sum(known * F.col("mean")).over(whole) / F.sum(F.when(F.col("mean").isNotNull(), known)).over(whole)
    spread = F.col("m2") + known * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))
    sketch = F.col("quantiles")
    sums = states.withColumn("centre", centre).groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.first("centre", True).alias("mean"), F.sum(spread).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.max(F.col("quantiles").isNotNull()).alias("numbers"),
    ).withColumn("count", F.col("rows") - F.col("nulls"))
    quantile = lambda p: F.when(F.col("numbers"), F.kll_sketch_get_quantile_double(sketch, F.lit(p)))
    deviation = F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))
    return sums.select(
        "column", "rows", "nulls", "count", (F.col("count") / F.col("rows")).alias("completeness"), "mean", deviation.alias("std"), "min",
        quantile(0.25).alias("p25"), quantile(0.5).alias("p50"), quantile(0.75).alias("p75"), "max",
        # nulls are hashed alike, so that they count as one value
        (F.col("distinct") - (F.col("nulls") > 0).cast("long")).alias("distinct"),
    )


def watch(stream: DataFrame, path: str, schema: Schema | None = None, columns: Sequence[str] | None = None, index: str = INDEX) -> DataStreamWriter:
    """A writer that keeps every batch's metrics, and the violations of ``schema``, under ``path``, a folder that all executors reach.

    ``unique`` rules can't be told from batches and raise. Start it with a ``checkpointLocation`` of its own.
    """
    unique = [c for c, r in (schema or {}).items() if (r.get("unique") if isinstance(r, dict) else r.unique)]
    if unique:
        raise InvalidParameter("schema", unique, "rules that single rows can break")

    def keep_batch(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch_metrics(batch, columns, index).write.mode("overwrite").parquet(f"{path}/metrics/batch={number}")
            if schema:
                schema_checks(batch, schema, index).write.mode("overwrite").parquet(f"{path}/checks/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(keep_batch)


def stream_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``merged_metrics`` of all batches kept under ``path``."""
    return merged_metrics(spark.read.parquet(f"{path}/metrics"))


def stream_checks(spark: SparkSession, path: str) -> DataFrame:
    """(column, check_name, violations) over all batches; a missing column counts once."""
    kept = spark.read.parquet(f"{path}/checks")
    total = F.when(F.col("check_name") == "column_missing", F.max("violations")).otherwise(F.sum("violations"))
    return kept.groupBy("column", "check_name").agg(total.alias("violations"))
