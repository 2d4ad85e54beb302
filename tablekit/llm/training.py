"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, rows: int, id: str = "doc_id", text: str = "text", label: str = "label",
    allowed: Column | None = None,
) -> DataFrame:
    """``id``, ``text`` and ``label`` of at most ``rows`` labelled documents: those whose ids have the smallest hashes.

    ``allowed`` is a condition on the column ``id``. Rows of ``labels`` without id or label are left out; of an id's several labels the
    highest holds, and of its several texts the smallest. The chosen ids are broadcast: there are at most ``rows``.
    """
    chosen = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    if allowed is not None:
        chosen = chosen.where(allowed)
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id", "label").agg(F.min("text").alias("text"))
