"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products within them.

Equal vectors are merged first. A vector belongs to its nearest centroid's cell and to every cell that is almost as near;
two vectors are compared, once, if they share a cell. Large cells are cut into blocks, and every pair of blocks is one group
of bounded size that returns counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.store import keep
from .graph import components

THRESHOLD = 0.93
#: A vector also belongs to the cells whose centroid's cosine is at most this much below the best one.
MARGIN = 0.12
#: Vectors that the centroids are fitted on at most, vectors in a block, and centroids at most.
SAMPLE_ROWS, BLOCK_ROWS, CELLS = 16_384, 1024, 4096


def _node(*columns: str) -> Column:
    """A name of 96 bits for the columns' values."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.hash(*columns)))


def _usable(label: str, vector: str) -> Column:
    """No nulls, no NaN or infinite component, and a length."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit vectors, from centroids far from each other; empty cells go to the worst placed vectors."""
    centroids = sample[:1]
    best = sample @ sample[0]
    while len(centroids) < min(k, len(sample)):
        centroids = np.vstack([centroids, sample[[int(best.argmin())]]])
        best = np.maximum(best, sample @ centroids[-1])
    for _ in range(rounds):
        near = sample @ centroids.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-9)
        sums[empty] = sample[np.argsort(near.max(axis=1))[: len(empty)]]
        centroids = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centroids


def _assign(held, margin: float):
    """The sorted cells of every vector. Vectors of another length than the centroids' share the cell of their length."""

    def assign(batches):
        centroids = held.value
        for batch in batches:
            cells = []
            for whole in batch.column("vector").to_pylist():
                if len(whole) != centroids.shape[1]:
                    cells.append([-len(whole)])
                    continue
                near = centroids @ _unit(np.array([whole], float))[0]
                cells.append(np.flatnonzero(near >= near.max() - margin))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return assign


def _links(threshold: float):
    """Of one pair of blocks (or one block with itself): links per vector, and its spanning forest."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        alike = frame["i"].iat[0] == frame["j"].iat[0]
        x = _unit(np.stack(frame["vector"].to_numpy()).astype(float))
        side = np.ones(len(frame), bool) if alike else (frame["block"] == frame["i"]).to_numpy()
        rows, columns = (np.arange(len(frame)),) * 2 if alike else (np.flatnonzero(side), np.flatnonzero(~side))
        linked = x[rows] @ x[columns].T >= threshold
        # A pair that shares a smaller cell is counted there.
        cell = frame["cell"].iat[0]
        smaller = [c[: np.searchsorted(c, cell)] for c in frame["cells"]]
        known = np.unique(np.concatenate([*smaller, np.zeros(0, np.int32)]))
        if len(known):
            held = np.zeros((len(frame), len(known)), np.float32)
            for r, c in enumerate(smaller):
                held[r, np.searchsorted(known, c)] = 1
            linked &= held[rows] @ held[columns].T == 0
        if alike:
            np.fill_diagonal(linked, False)
        weight = frame["copies"].to_numpy()
        count = np.zeros(len(frame), np.int64)
        count[rows] += linked.astype(np.int64) @ weight[columns]
        if not alike:
            count[columns] += linked.T.astype(np.int64) @ weight[rows]
        root = np.arange(len(frame))
        while True:
            least = np.full(len(frame), len(frame))
            a, b = np.nonzero(linked)
            np.minimum.at(least, rows[a], root[columns[b]])
            np.minimum.at(least, columns[b], root[rows[a]])
            new = np.minimum(root, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = count > 0
        node = frame["node"].to_numpy()
        return pd.DataFrame({"node": node[some], "links": count[some], "root": node[root[some]]})

    return links


def near_duplicates(
    vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
    margin: float = MARGIN, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS, cells: int = CELLS,
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Two rows link when their labels are equal and the cosine in double precision is ``threshold`` or more. Vectors that are null,
    zero or hold a null or non-finite component, and rows without label, link with nothing; vectors of different lengths don't
    link. ``component_id`` is the smallest id reachable by links and ``kept`` whether the row has it; rows without id have
    no ``component_id`` of their own and are kept where they have none. Repeated rows are vectors that link with each
    other. Other columns are not read; an empty table gives an empty one.

    The centroids are fitted on ``sample_rows`` vectors at most, one for each ``block_rows`` of the largest label's vectors up to
    ``cells``; all vectors are indexed. A pair can only be missed if the cells of both differ and each is farther than
    ``margin`` from the other's best: ``margin=2`` compares all pairs of a label.
    """
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("node", F.when(_usable("label", "vector"), _node("label", "vector")))
    unique = keep(
        rows.where("node is not null").groupBy("node", "label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    )
    sample = np.stack(_sample(unique, sample_rows)).astype(float) if not unique.isEmpty() else np.ones((1, 1))
    largest = unique.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    centroids = fit_centroids(_unit(sample), min(cells, -(-largest // block_rows)) or 1)
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    slim = unique.select("node", "label", "vector", "copies")
    kind = slim.schema["vector"].dataType.simpleString()
    schema = f"node string, label {dict(slim.dtypes)['label']}, vector {kind}, copies long, cells array<int>"
    placed = keep(slim.mapInArrow(_assign(held, margin), schema)).withColumn("cell", F.explode("cells"))
    sizes = keep(placed.groupBy("label", "cell").count().where(F.col("count") > block_rows).select("label", "cell", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    blocked = placed.join(sizes, ["label", "cell"], "left").fillna(1, "blocks").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    found = keep(paired.groupBy("label", "cell", "i", "j").applyInPandas(_links(threshold), "node string, links long, root string"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Only vectors with links or copies differ from rows that stand alone.
    notable = unique.select("node", "least", "copies").join(links, "node", "left").join(roots, "node", "left").where("copies > 1 or links is not null")
    notable = keep(notable.select("node", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    smallest = notable.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = notable.join(smallest, "root").select("node", "n_links", "component_id")
    # Rows without a usable vector get a key of their own, so that they don't meet in one task.
    spread = rows.select("id", F.coalesce("node", F.xxhash64("id").cast("string")).alias("node"))
    component = F.coalesce("component_id", "id")
    return spread.join(answers, "node", "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _sample(unique: DataFrame, rows: int) -> list:
    """The vectors of one length, that of the most, among those with the smallest names."""
    held = unique.orderBy("node").limit(rows).select("vector").toPandas()["vector"].to_list()
    sizes = [len(v) for v in held]
    common = max(sorted(set(sizes)), key=sizes.count)
    return [v for v in held if len(v) == common]
