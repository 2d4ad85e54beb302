"""Tables written to the shared checkpoint folder.

A plan that is read twice and must give the same rows both times (range boundaries, generated ids) is written
once and read back. The table survives lost executors and, unlike a checkpointed RDD, keeps column pruning.
The folder is the one the cluster names in ``spark.checkpoint.dir``; its retention policy removes old tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidParameter


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidParameter("spark.checkpoint.dir", None, "a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablekit-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tablekit/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
