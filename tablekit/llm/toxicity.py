"""Toxicity grades by cumulative-link ordinal regression on the words of a text.

One weight vector is shared by all thresholds: P(grade <= k) = sigmoid(threshold[k] - weights . features). The model is
fitted on a bounded sample of labelled rows; all documents are then scored in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.store import keep
from .training import labelled_sample
from .words import ALPHANUMERIC, slices, words

#: Labelled rows that the fit uses at most. The model has all words of these rows, but for those of very few rows.
SAMPLE_ROWS = 12_000


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted hashes of words
    weights: np.ndarray
    thresholds: np.ndarray

    def expected(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of each grade or a higher one."""
        above = 1 - _sigmoid(self.thresholds[None, :] - eta[:, None])
        return above.sum(axis=1), above


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _features(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and log(1 + count) of the words that the vocabulary knows."""
    found = words(column, ALPHANUMERIC)
    at = np.minimum(np.searchsorted(vocabulary, found.hashes), len(vocabulary) - 1)
    known = vocabulary[at] == found.hashes
    keys, counts = np.unique(found.rows()[known] * len(vocabulary) + at[known], return_counts=True)
    return keys // len(vocabulary), keys % len(vocabulary), np.log1p(counts)


def _hashes(batches):
    for batch in slices(batches, "text"):
        found = words(batch.column("text"), ALPHANUMERIC)
        rows = [np.unique(found.hashes[a:b]).view(np.int64) for a, b in zip(found.offsets, found.offsets[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], ["words"])


def _vectors(vocabulary):
    def vectors(batches):
        for batch in slices(batches, "text"):
            row, word, value = _features(batch.column("text"), vocabulary)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(cut, pa.array(word, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(value, pa.float64()))],
                ["id", "label", "word", "value"],
            )
    return vectors


def fit(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", grade: str = "grade", binary: bool = False,
    sample_rows: int = SAMPLE_ROWS, min_documents: int = 3, steps: int = 400, l2: float = 1e-4,
) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows. ``grade`` holds 0, 1, 2, ...

    With ``binary`` the labels are only 0 and 1, and rows labelled 1 are graded 1 to 3 first: by terciles of how many of their
    words are marked, that is, occur at least nine times as often in rows labelled 1. Words in fewer than ``min_documents`` texts
    of the sample have no weight. Without a labelled row or without words the model gives every text grade 0.
    """
    sample = keep(labelled_sample(docs, labels, rows=sample_rows, id=id, text=text, label=grade))
    counted = sample.select("text").mapInArrow(_hashes, "words array<long>").select(F.explode("words").alias("word")).groupBy("word").count()
    known = counted.where(F.col("count") >= min_documents).select("word").toPandas()  # words of the bounded sample
    known = np.sort(known["word"].to_numpy(np.int64).view(np.uint64))
    none = ToxicityModel(np.zeros(1, np.uint64), np.zeros(1), np.full(1, 30.0))
    if not len(known):
        return none
    rows = sample.mapInArrow(_vectors(known), f"id {dict(sample.dtypes)['id']}, label int, word array<int>, value array<double>").toPandas().sort_values("id")
    if rows.empty:
        return none
    y = rows["label"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(rows)), rows["word"].str.len().to_numpy())
    word, value = (np.concatenate([*rows[c], np.zeros(0)]) for c in ("word", "value"))
    word = word.astype(np.int64)
    if binary:
        y = _grades(y, row, word, value, len(known))
    y = np.unique(y, return_inverse=True)[1] if y.min() > 0 else y
    return _descend(known, y, row, word, value, steps, l2)


def _grades(y, row, word, value, size):
    """Rows labelled 1 get 1 to 3 by how often they use words that mark such rows."""
    toxic = y[row] > 0
    share1 = np.bincount(word[toxic], minlength=size) / max(1, (y > 0).sum())
    share0 = np.bincount(word[~toxic], minlength=size) / max(1, (y == 0).sum())
    marked = share1 > 9 * np.maximum(share0, 1e-4)
    used = np.bincount(row, np.expm1(value) * marked[word], minlength=len(y))
    cuts = np.quantile(used[y > 0], [1 / 3, 2 / 3]) if (y > 0).any() else [0, 0]
    return np.where(y > 0, 1 + (used > cuts[0]) + (used > cuts[1]), 0)


def _descend(known, y, row, word, value, steps, l2):
    """Maximum likelihood by Adam; the gaps between thresholds are exponentials, so that they stay in order."""
    grades = max(1, int(y.max()))
    n, w = len(y), np.zeros(len(known))
    base = np.log((np.arange(grades)[:, None] >= y[None, :]).mean(axis=1).clip(1e-3, 1 - 1e-3))
    base = base - np.log1p(-np.exp(base))
    t = np.concatenate([base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    params = np.concatenate([w, t])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, t = params[: len(known)], params[len(known) :]
        thresholds = t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])
        eta = np.bincount(row, w[word] * value, minlength=n)
        edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
        hi, lo = _sigmoid(edge[y + 1] - eta), _sigmoid(edge[y] - eta)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_eta = (dhi - dlo) / n  # of the negative log likelihood
        d_edge = np.bincount(y, -dhi / n, minlength=grades + 1)[:grades]
        d_edge += np.bincount(y, dlo / n, minlength=grades + 1)[1 : grades + 1]
        d_t = np.concatenate([[d_edge.sum()], np.exp(t[1:]) * np.cumsum(d_edge[::-1])[::-1][1:]])
        grad = np.concatenate([np.bincount(word, d_eta[row] * value, minlength=len(known)) + l2 * w, d_t])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, t = params[: len(known)], params[len(known) :]
    return ToxicityModel(known, w, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]))


def score(docs: DataFrame, model: ToxicityModel, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``expected_severity`` (0 to the highest grade), ``grade`` (the most likely one),
    ``p_toxic`` (of any grade above 0) and ``toxic`` (whether that is at least one half).

    Whole texts count. Null and empty texts have no words, so that the thresholds alone grade them. Repeated rows get equal
    scores. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def grade(batches):
        m = held.value
        for batch in slices(batches, "text"):
            row, word, value = _features(batch.column("text"), m.vocabulary)
            expected, above = m.expected(np.bincount(row, m.weights[word] * value, minlength=batch.num_rows))
            each = np.diff(np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))]) * -1, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(expected), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                ["id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    named = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = dict(named.dtypes)["id"]
    return named.mapInArrow(grade, f"id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("id", id)
