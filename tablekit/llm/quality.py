"""Text quality from random-indexing word vectors and a small network.

Every word has a sparse random index vector, made from its hash. A word's vector is the sum of the index vectors of the
words around it, over all documents. A document is pooled to the mean and spread of its words' vectors; two dense layers
in numpy score that, and a temperature fitted on rows kept apart makes the scores probabilities.

Words share ``BUCKETS`` slots by their hash, so that what is gathered from the corpus (one sum per slot and task) and the
model have a fixed size whatever the number of different words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .training import labelled_sample
from .words import WORDS_AND_MARKS, mix, slices, words

BUCKETS, DIMENSIONS, NONZERO, REACH = 4096, 64, 4, 2
#: Labelled rows that the network is fitted on at most.
SAMPLE_ROWS = 16_000
#: The score from which a document counts as good.
THRESHOLD = 0.3
_SLICE = 1 << 20


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each slot's index vector."""
    seeds = mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64)).reshape(BUCKETS, NONZERO)
    return (seeds % np.uint64(DIMENSIONS)).astype(np.int64), np.where(seeds >> np.uint64(63), 1.0, -1.0)


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every word of a column, and the rows' offsets. A word that repeats the one before has slot 0."""
    found = words(column, WORDS_AND_MARKS, lower=False)
    slot = 1 + (found.hashes % np.uint64(BUCKETS - 1)).astype(np.int64)
    again = np.zeros(len(slot), bool)
    again[1:] = found.hashes[1:] == found.hashes[:-1]
    again[found.offsets[:-1][found.counts > 0]] = False
    slot[again] = 0
    return slot, found.offsets


def _contexts(batches):
    """The task's sum of neighbours' index vectors for each slot, and the slot's number of words."""
    places, signs = _index_vectors()
    total, seen = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text", _SLICE):
        slot, offsets = _slots(batch.column("text"))
        seen += np.bincount(slot, minlength=BUCKETS)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for step in range(1, REACH + 1):
            same = row[step:] == row[:-step]
            left, right = slot[:-step][same], slot[step:][same]
            for word, near in ((left, right), (right, left)):
                for k in range(NONZERO):
                    total += np.bincount(word * DIMENSIONS + places[near, k], signs[near, k], BUCKETS * DIMENSIONS)
    used = np.flatnonzero(seen)
    vectors = total.reshape(BUCKETS, DIMENSIONS)[used].astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(seen[used]), *(pa.array(vectors[:, k]) for k in range(DIMENSIONS))],
        ["slot", "seen", *(f"c{k}" for k in range(DIMENSIONS))],
    )


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The vector of each slot from all rows of ``docs``, weighted down for frequent words."""
    names = ["seen", *(f"c{k}" for k in range(DIMENSIONS))]
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_contexts, "slot int, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    vectors, seen = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    slot = sums["slot"].to_numpy()
    for k, n in enumerate(names[1:]):
        vectors[slot, k] = sums[n].to_numpy()
    seen[slot] = sums["seen"].to_numpy()
    share = seen / max(1.0, seen.sum())
    vectors -= vectors.sum(axis=0) * share[:, None]  # what a word's neighbours have beyond those of any word
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    return vectors * (1e-2 / (1e-2 + share))[:, None]


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the rows' word vectors; zero for a row without words."""
    slot, offsets = _slots(column)
    out = np.zeros((len(offsets) - 1, 2 * DIMENSIONS))
    counts = np.diff(offsets)
    full = np.flatnonzero(counts)
    # A long text is pooled in pieces of a bounded number of words.
    for a in range(0, len(slot), 1 << 14):
        b = min(len(slot), a + (1 << 14))
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        rows = np.arange(first, last)
        cut = np.clip(offsets[rows], a, b) - a
        rows, cut = rows[counts[rows] > 0], cut[counts[rows] > 0]
        held = vectors[slot[a:b]]
        out[rows, :DIMENSIONS] += np.add.reduceat(held, cut, axis=0)
        out[rows, DIMENSIONS:] += np.add.reduceat(held * held, cut, axis=0)
    out[full] /= counts[full, None]
    out[:, DIMENSIONS:] = np.sqrt(np.maximum(out[:, DIMENSIONS:] - out[:, :DIMENSIONS] ** 2, 0))
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple  # weights and biases of the two layers
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ a + b) @ c + d

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * self.logits(pooled) / self.temperature))


def _pooled(held):
    def pooled(batches):
        for batch in slices(batches, "text", _SLICE):
            rows = pa.array([x.tobytes() for x in pool(batch.column("text"), held.value)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), rows], ["id", "label", "pooled"])
    return pooled


def _gathered(sample: DataFrame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled vectors and labels of a sample, by the hash of the id. They reach the driver as bytes, never as a Python object for each number."""
    held = sample.sparkSession.sparkContext.broadcast(vectors)
    rows = sample.mapInArrow(_pooled(held), f"id {dict(sample.dtypes)['id']}, label int, pooled binary").withColumn("at", F.xxhash64("id")).toArrow()
    rows = rows.take(pc.sort_indices(rows.select(["at", "id"]), [("at", "ascending"), ("id", "ascending")]))
    x = np.frombuffer(b"".join(rows["pooled"].to_pylist())).reshape(rows.num_rows, 2 * DIMENSIONS)
    return x, rows["label"].to_numpy().astype(float)


def fit(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality",
    allowed: Column | None = None, sample_rows: int = SAMPLE_ROWS, hidden: int = 32, epochs: int = 60,
) -> QualityModel:
    """Word vectors from all of ``docs``; the network from at most ``sample_rows`` labelled rows that ``allowed`` lets in.

    A fifth of the rows (by the hash of their id) fits the temperature only. Labels are 0 or 1. Without a usable label every text
    scores one half; with labels of one kind only, the score is that kind's smoothed share.
    """
    vectors = word_vectors(docs, text)
    sample = labelled_sample(docs, labels, rows=sample_rows, id=id, text=text, label=label, allowed=allowed)
    x, y = _gathered(sample, vectors)
    width = 2 * DIMENSIONS
    if len(set(y.tolist())) < 2:
        good = (y.sum() + 1) / (len(y) + 2)
        layers = (np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(good / (1 - good))))
        return QualityModel(vectors, np.zeros(width), np.ones(width), layers, 1.0)
    apart = np.arange(len(y)) % 5 == 0
    mean, scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-6
    model = QualityModel(vectors, mean, scale, _train((x[~apart] - mean) / scale, y[~apart], hidden, epochs), 1.0)
    raw = model.logits(x[apart])
    loss = lambda t: np.logaddexp(0, np.where(y[apart] > 0, -raw, raw) / t).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 200), key=loss))
    return model


def _train(x, y, hidden, epochs):
    """Both layers by Adam with weight decay on batches in a fixed random order."""
    rng = np.random.default_rng(7)
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            a, b, c, d = params
            h = np.tanh(x[batch] @ a + b)
            g = (0.5 * (1 + np.tanh(0.5 * (h @ c + d))) - y[batch]) / len(batch)
            back = np.outer(g, c) * (1 - h * h)
            grads = [x[batch].T @ back + 1e-3 * a, back.sum(axis=0), h.T @ g + 1e-3 * c, np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return (*params[:3], float(params[3][0]))


def score(docs: DataFrame, model: QualityModel, *, id: str = "doc_id", text: str = "text", extra: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``extra`` columns, and ``score``, the probability of label 1 by the whole text.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    row = F.struct(F.col(id).alias("id"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(extra)])
    named = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    within = 1 + list(extra).index(text) if text in extra and dict(docs.dtypes)[text] == "string" else None
    if within:  # the text isn't sent twice
        named = named.select("row")

    def scored(batches):
        if within:
            batches = (pa.RecordBatch.from_arrays([b.column("row"), b.column("row").field(within)], ["row", "text"]) for b in batches)
        for batch in slices(batches, "text", _SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(held.value.scores(pool(batch.column("text"), held.value.vectors)))], ["row", "score"])

    out = named.mapInArrow(scored, f"row {named.schema['row'].dataType.simpleString()}, score double")
    return out.select(F.col("row.id").alias(id), *[F.col(f"row.x{k}").alias(c) for k, c in enumerate(extra)], "score")


def held_out(id: Column) -> Column:
    """Documents whose labels are never learnt: crc32 of the id as text is a multiple of 5."""
    return F.crc32(id.cast("string").cast("binary")) % 5 == 0
