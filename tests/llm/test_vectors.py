import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.llm import graph, vectors
from tablekit.llm.queries import QUERIES

DATA = "/root/testdata/sf0.1"
#: A table with groups of near copies, where there is one.
COPIES = "/root/testdata/check_s"


def brute(rows, threshold=0.93):
    """``rows``: id, label, vector. Links by comparing all pairs of a label."""
    n = len(rows)
    ok = [label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, label, v in rows]
    neighbours = [set() for _ in range(n)]
    groups = {}
    for k in range(n):
        if ok[k]:
            groups.setdefault((rows[k][1], len(rows[k][2])), []).append(k)
    for members in groups.values():
        x = vectors._unit(np.array([rows[k][2] for k in members], float))
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                neighbours[members[a]].add(members[b])
    component = [None] * n
    for k in sorted(range(n), key=lambda k: (rows[k][0] is None, rows[k][0])):
        if component[k] is None:
            todo, component[k] = [k], (rows[k][0],)
            while todo:
                for m in neighbours[todo.pop()]:
                    if component[m] is None:
                        component[m] = (rows[k][0],)
                        todo.append(m)
    return sorted(((r[0], len(s), c[0], r[0] == c[0]) for r, s, c in zip(rows, neighbours, component)), key=str)


def collected(df):
    return [(r.vec_id, r.label, r.embedding) for r in df.collect()]


def answers(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("data", [DATA, COPIES])
def test_whole_table(spark, data):
    if not os.path.isdir(data):
        pytest.skip("no such table")
    want = brute(collected(spark.read.parquet(f"{data}/embeddings.parquet")))
    assert answers(QUERIES["op4_vectors"](spark, data)) == want
    assert data == DATA or any(n for _, n, _, _ in want)


@pytest.fixture(scope="module")
def noisy(spark):
    """Vectors with copies at all cosines around the threshold, and one crowded label."""
    rng, rows = np.random.default_rng(2), []
    for label in range(3):
        base = rng.normal(size=(200, 32))
        copies = base[rng.integers(0, 200, 300)]
        noise = rng.normal(size=copies.shape) * rng.uniform(0, 0.5, size=(300, 1))
        rows += [(label, v) for v in [*base, *(copies + noise)]]
    centre = rng.normal(size=32)
    rows += [(1, centre + 0.1 * rng.normal(size=32)) for _ in range(150)] + [(1, centre)] * 50
    order = rng.permutation(len(rows))
    table = [(int(i), rows[k][0], rows[k][1].astype(np.float32).tolist()) for i, k in enumerate(order)]
    return table, spark.createDataFrame(table, "vec_id long, label int, embedding array<float>")


def test_blocks_and_all_pairs(noisy):
    table, df = noisy
    assert answers(vectors.near_duplicates(df, margin=2, block_rows=64)) == brute(table)


def test_recall_with_the_margin(noisy):
    table, df = noisy
    got = sum(n for _, n, _, _ in answers(vectors.near_duplicates(df, block_rows=64)))
    want = sum(n for _, n, _, _ in brute(table))
    assert 0.97 * want <= got <= want


NAN, INF = float("nan"), float("inf")
ODD = [
    (1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [0.0, 0.0]), (4, 0, [0.0, 0.0]), (5, None, [1.0, 0.0]), (6, None, [1.0, 0.0]),
    (7, 0, None), (8, 0, [NAN, 1.0]), (9, 0, [NAN, 1.0]), (10, 0, [INF, 1.0]), (11, 0, [None, 1.0]), (12, 0, []), (13, 1, [1.0, 0.0]),
    (14, 0, [1.0, 0.0, 0.0]), (15, 0, [1.0, 0.0, 0.0]), (None, 2, [1.0, 1.0]), (16, 2, [1.0, 1.01]), (None, 3, [1.0]), (17, 4, [1e300, 1e300]), (18, 4, [1e-300, 1e-300]),
    (19, 5, [-0.0, 1.0]), (20, 5, [0.0, 1.0]), (21, 5, [1.0, 0.0]),
]


@pytest.mark.parametrize("block_rows", [1, 1024])
def test_edge_cases(spark, block_rows):
    df = spark.createDataFrame([(*r, "x", 5) for r in ODD], "vec_id long, label int, embedding array<double>, node string, id int")
    assert answers(vectors.near_duplicates(df, block_rows=block_rows, margin=2)) == brute(ODD)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(0)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(400)] + [("hub", f"s{i}") for i in range(300)] + [("x", "x"), ("p", "q"), ("q", "p")]
    name = {n: f"{rng.integers(1 << 60):x}" for n in sorted({n for p in pairs for n in p})}
    df = spark.createDataFrame([(name[a], name[b]) for a, b in pairs], "a string, b string")
    found = {r.node: r.root for r in graph.components(df).collect()}
    groups = [{name[n] for n in name if n[0] == "c"}, {name[n] for n in name if n[0] in "hs"}, {name["p"], name["q"]}]
    assert set(found) == set.union(*groups)
    assert all(len({found[n] for n in g}) == 1 and found[min(g)] in g for g in groups) and len(set(found.values())) == 3
    assert graph.components(df.limit(0)).count() == 0
