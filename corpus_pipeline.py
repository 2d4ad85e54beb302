"""The corpus pipeline: stages over the documents, each written as Parquet and read again.

A stage takes the session, the documents that its predecessor kept, and the folder of the tables. All but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekit.llm import decontaminate, jaccard, pieces, quality, secrets
from tablekit.llm.queries import piece_model, secret_forest, table
from tablekit.plans.store import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of which a greater share of words is found in the benchmark goes; others lose those words.
LEAKED_SHARE = 0.5


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on them and the labels, doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), allowed=~quality.held_out(F.col("id")))
    scored = quality.score(docs, model, extra=COLUMNS[1:])
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on runs of five words, the one with the smallest id.

    Documents are told apart by id and text. Of a group's texts with the same smallest id, that with the smallest hash stays, and
    of rows equal in both, one. A row without id goes if a document with an id is in its group.
    """
    found = keep(jaccard.similarity_join(docs, size=5, threshold=0.8).where("component_id is not null"))
    it = F.struct("doc_id", "key").alias("it")
    first = found.where("doc_id = component_id")
    several = first.groupBy("group").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    gone = found.where("doc_id is null or doc_id <> component_id").select(it).union(first.join(several, "group").where("key <> low").select(it))
    held = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("key")).alias("it"))
    kept = held.join(gone.distinct(), "it", "left_anti")
    # Rows equal in id and text are few; only they are grouped.
    again = first.groupBy("doc_id", "key").count().where("count > 1").select(it)
    once, more = kept.join(again, "it", "left_anti"), kept.join(again, "it", "left_semi").dropDuplicates(["it"])
    return once.unionByName(more).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that occur in windows of the benchmark; those mostly made of them go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), extra=COLUMNS[2:], cut=True)
    return _recounted(decontaminate.remove_documents(found, LEAKED_SHARE))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return _recounted(secrets.redacted(docs.select(*COLUMNS), secret_forest(docs), path="source"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids with the end id, their number, and digests of the ids and of the text that they decode to."""
    rows = pieces.encode(docs, piece_model(), decoded=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_quality), ("n-gram Jaccard join", without_near_duplicates), ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets), ("SentencePiece encoding and decoding", token_ids),
]

#: Training and tokenization can't be said in SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
