import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablekit.llm import quality, toxicity
from tablekit.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
WEIRD = [(1, None), (2, ""), (3, "same same same " * 9000), (3, "same same same " * 9000), (None, "you worthless idiot"), (4, "\x00  ü")]


def weird(spark):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in WEIRD], "doc_id long, text string, label int, row string, score double")


def test_quality_on_rows_kept_apart(spark):
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, DATA).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    apart = [(got[i], y) for i, y in labels.items() if got[i].held_out]
    assert np.mean([r.predicted == y for r, y in apart]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_word_vectors_equal_a_plain_sum(spark):
    text = "a b a a c"
    slots, _ = quality._slots(pa.array([text]))
    places, signs = quality._index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for i, word in enumerate(slots):
        for j, near in enumerate(slots):
            if 0 < abs(i - j) <= quality.REACH:
                np.add.at(want[word], places[near], signs[near])
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    (out,) = quality._contexts([batch])
    got = np.stack([out.column(f"c{k}").to_numpy() for k in range(quality.DIMENSIONS)], axis=1)
    assert (got == want[out.column("slot").to_numpy()]).all() and slots[3] == 0


def test_pooling_a_long_text_in_pieces():
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMENSIONS))
    texts = ["", " ".join(map(str, range(300_000))), None, "b"]
    slot, offsets = quality._slots(pa.array(texts))
    got = quality.pool(pa.array(texts), vectors)
    for r in (1, 3):
        held = vectors[slot[offsets[r] : offsets[r + 1]]]
        assert np.allclose(got[r], np.concatenate([held.mean(axis=0), held.std(axis=0)]), atol=1e-6)
    assert not got[[0, 2]].any()


def test_quality_edge_cases(spark):
    docs, labels = weird(spark), spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (9, 0)], "doc_id long, quality int")
    scores = quality.score(docs, quality.fit(docs, labels), extra=["label"]).collect()
    assert len(scores) == len(WEIRD) and len({r.score for r in scores if r.doc_id == 3}) == 1
    assert {r.score for r in scores if r.doc_id in (1, 2)}.__len__() == 1
    empty = docs.limit(0)
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_toxic_documents_of_the_table(spark):
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, DATA).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    assert np.mean([got[i].toxic for i, y in labels if y]) > 0.95
    assert np.mean([got[i].toxic for i, y in labels if not y]) < 0.02
    assert all(0 <= r.expected_severity <= 3 and r.grade in range(4) for r in got.values())


def test_toxicity_learns_on_other_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.fit(docs, known, grade="toxic", binary=True)).collect()}
    rest = labels.join(known, "doc_id", "left_anti").collect()
    assert np.mean([got[r.doc_id] == (r.toxic == 1) for r in rest]) > 0.93


def test_grades_are_ordered_by_one_weight_vector(spark):
    """More of the marking word, a higher grade; every threshold above the one before."""
    texts = [" ".join(["calm words here"] + ["bad"] * g * 2) for g in range(4) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 12) for i in range(48)], "doc_id long, grade int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    severity = [r.expected_severity for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert severity[0] < severity[12] < severity[24] < severity[36]


def test_every_word_of_the_sample_has_a_weight(spark):
    """More than 32,768 other words stand in more texts than the marking one."""
    many = [" ".join(f"w{i}" for i in range(40_000))] * 8
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(many + ["fine words"] * 4 + ["rareslur words"] * 3)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i > 11)) for i in range(15)], "doc_id long, toxic int"), grade="toxic", binary=True)
    assert len(model.vocabulary) == 40_000 + 3
    assert [r.toxic for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == [False] * 12 + [True] * 3


def test_gradient_is_that_of_the_likelihood():
    row, word, value = np.array([0, 1, 2, 2, 3]), np.array([0, 0, 0, 1, 1]), np.array([0.7, 1.4, 2.0, 0.7, 0.7])
    model = toxicity._descend(np.arange(2, dtype=np.uint64), np.array([0, 1, 2, 0]), row, word, value, 3000, 0.05)

    def loss(w, t):
        eta = np.bincount(row, w[word] * value, minlength=4)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        y = np.array([0, 1, 2, 0])
        return -np.log(toxicity._sigmoid(edge[y + 1] - eta) - toxicity._sigmoid(edge[y] - eta)).mean() + 0.025 * (w @ w)

    best = loss(model.weights, model.thresholds)
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(model.weights + step * np.eye(2)[k], model.thresholds) > best
            assert loss(model.weights, model.thresholds + step * np.eye(2)[k]) > best


@pytest.mark.parametrize("binary", [True, False])
def test_toxicity_edge_cases(spark, binary):
    docs, labels = weird(spark), spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, grade="toxic", binary=binary, min_documents=1)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(WEIRD) and all(np.isfinite(r.expected_severity) for r in scores)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, grade="toxic")).count() == 0
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0), grade="toxic")).collect())
    assert len(scores[0]) == 5


def test_a_labelled_sample_reaches_the_driver_as_bytes(spark):
    """Sixteen thousand pooled vectors are 16 MB, not a Python object for each of their two million numbers."""
    rows = 16_000
    docs = spark.range(rows).selectExpr("id AS doc_id", "concat('word', id % 97, ' other', id % 89, ' last') AS text")
    labels = spark.range(rows).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    tracemalloc.start()
    try:
        quality.fit(docs, labels, epochs=0)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 70
