import pickle

import brute
import duckdb
from pyspark.sql import functions as F

from tablekit.llm import decontaminate as d
from tablekit.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    got = QUERIES["op10_decontamination"](spark, DATA)
    assert rows(got) == sorted(brute.contamination(docs, items), key=str)
    assert sum(r.contaminated for r in got.collect()) > 0


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven"), (10, "über-cool"), (2, None), (None, "zzz"), (3, "--"), (1, "alpha")]
DOCS = [
    (1, "x one two three, four five six seven eight nine ten eleven y"), (2, None), (3, ""), (3, ""), (4, "über cool!"),
    (None, "alpha beta ALPHA"), (5, "zzz one two three"), (6, "Über-cool über cool cool " + "w " * 50_000), (1, "cool"),
]


def tables(spark):
    docs = spark.createDataFrame([(*r, 7, "x") for r in DOCS], "doc_id long, text string, n_words int, hit string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_edge_cases_and_slices(spark):
    docs, items = tables(spark)
    want = sorted(brute.contamination(DOCS, ITEMS), key=str)
    assert rows(d.contamination_report(docs, items)) == want
    assert rows(d.contamination_report(docs, items, slice_bytes=20)) == want
    assert rows(d.contamination_report(docs.limit(0), items)) == []
    assert all(not r.contaminated for r in d.contamination_report(docs, items.limit(0)).collect())


def test_removal(spark):
    docs, items = tables(spark)
    found = d.find_contamination(docs, items)
    texts = {(r.doc_id, r.text) for r in d.remove_spans(found).collect()}
    assert (1, "x  y") in texts and (4, "!") in texts and (None, " beta ") in texts and (2, None) in texts
    assert {r.doc_id for r in d.remove_documents(found).collect()} == {1, 2, 3, 5}
    for slice_bytes in (d.SLICE_BYTES, 20):
        cut = d.find_contamination(docs, items, cut=True, slice_bytes=slice_bytes, extra=["hit"])
        assert {(r.doc_id, r.text) for r in cut.collect()} == texts


def test_windows_stay_near_their_counted_bytes(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(200))) for k in range(200)], "id string, text string")
    each = items.mapInArrow(d._of_items(10), "length int, hash long, words binary, item string")
    rows = each.groupBy("length", "hash", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = d._Windows(rows.toArrow())
    assert len(held.hashes) == 200 * 191
    counted = len(held.data) + 32 * len(held.hashes) + 6 * len(held.item_at)
    assert len(pickle.dumps(held)) < 1.2 * counted


def test_texts_stay_in_their_rows(spark):
    docs, items = tables(spark)
    plan = d.find_contamination(docs, items, cut=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
