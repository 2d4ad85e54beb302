"""The registered queries of this package and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.store import checkpoint_root
from . import alignment, decontaminate, jaccard, layout, packing, pieces, quality, secrets, shards, toxicity, turns, vectors, warc
from .oracles import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op10_decontamination(spark, d):
    return decontaminate.contamination_report(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op1_toxicity(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels, grade="toxic", binary=True))


@query
def op3_quality(spark, d):
    docs = table(spark, d, "documents")
    model = quality.fit(docs, table(spark, d, "labels"), allowed=~quality.held_out(F.col("id")))
    scored = quality.score(docs, model)
    apart = F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def _vocabulary(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def piece_model() -> bytes:
    return _vocabulary("piece_bpe_32k.model")


def rank_file() -> bytes:
    return _vocabulary("byte_bpe_50k.tiktoken")


@query
def op7_sentencepiece(spark, d):
    rows = pieces.encode(table(spark, d, "documents"), piece_model(), decoded=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), rank_file())


@query
def op8_warc(spark, d):
    path = f"{checkpoint_root(spark)}/tablekit/warc/{uuid.uuid4().hex}"
    pages = table(spark, d, "pages")
    warc.write(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    return warc.read(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


@query
def op5_html(spark, d):
    return layout.extract(table(spark, d, "pages"))


@query
def op4_vectors(spark, d):
    return vectors.near_duplicates(table(spark, d, "embeddings"))


@query
def op6_jaccard(spark, d):
    return jaccard.similarity_join(table(spark, d, "documents"), size=3, threshold=0.9).drop("key", "group")


def secret_forest(docs: DataFrame) -> secrets.Forest:
    """The tables hold no labelled findings: strict formats label those of ``documents``."""
    return secrets.fit(secrets.findings(docs, path="source").withColumn("label", secrets.strict_label()))


@query
def op2_secrets(spark, d):
    docs = table(spark, d, "documents")
    found = secrets.scan(docs, secret_forest(docs), path="source")
    return found.select("doc_id", "start", "length", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score", "is_secret")


@query
def op13_alignment(spark, d):
    docs = table(spark, d, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return alignment.align(docs, _vocabulary("byte_bpe_50k.json"), piece_model())


@query
def op11_sharding(spark, d):
    docs = table(spark, d, "documents")
    dims = {"length": F.log2(F.col("n_chars") + 1.0), "source": F.col("source"), "lang": F.col("lang")}
    placed = shards.shard(docs, dims, shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op12_conversations(spark, d):
    rows = table(spark, d, "conversations")
    report = turns.Repair(turns.damaged(rows)).report()
    numbers = [c for c, kind in report.dtypes if kind == "bigint" and c != "conv_id"]
    everyone = rows.select("conv_id").distinct()
    found = everyone.join(report.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    return found.fillna(0, numbers).fillna({"audit": ""}).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
