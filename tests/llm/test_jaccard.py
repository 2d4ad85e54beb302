import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablekit.llm import graph, jaccard
from tablekit.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def joined(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_join(docs, **options).collect()}


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.similar(docs, 3, 0.9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_jaccard"](spark, DATA).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def mutated(draw, words, share):
    return [draw.choice("xyzuvw") + w if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def crowd(spark):
    """Chains and crowds of near copies around the threshold, a passage that all share, and odd texts."""
    draw = random.Random(9)
    syllables = [a + b for a in "bcdfgklm" for b in "aeiou"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 3)))
    common = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(draw.randint(20, 160))]
        for _ in range(draw.randint(1, 14)):
            texts.append(" ".join(mutated(draw, base, draw.choice([0, 0.005, 0.01, 0.02, 0.05]))))
            if draw.random() < 0.3:
                base = mutated(draw, base, 0.02)  # a chain
    texts += [" ".join([word() for _ in range(draw.randint(1, 30))] + common) for _ in range(80)]
    texts += [" ".join(common + [str(k)]) for k in range(30)]
    texts += ["", None, " \n", "one", "ONE", "one two", "a b c d", "a  b\tc d", "a b c d e", "w " * 30_000, "w w w", "w w w w"] * 2
    draw.shuffle(texts)
    docs = list(enumerate(texts, 100))
    return docs, spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, n int, name string, node int")


@pytest.mark.parametrize("size,threshold", [(3, 0.9), (5, 0.8), (1, 0.5)])
@pytest.mark.parametrize("block,frequent", [(1024, 200_000), (3, 5)])
def test_crowd(crowd, size, threshold, block, frequent):
    docs, df = crowd
    assert joined(df, size=size, threshold=threshold, block=block, frequent=frequent) == brute.similar(docs, size, threshold)


def test_without_the_first_part(crowd, monkeypatch):
    """Signature trees alone find every link."""
    docs, df = crowd
    monkeypatch.setattr(jaccard, "AGREEING", 2.0)
    assert joined(df, size=3, threshold=0.9, block=8) == brute.similar(docs, 3, 0.9)


def test_traversal_drops_no_pair_and_drops_most():
    rng = np.random.default_rng(1)
    base = [rng.integers(1, 1 << 62, rng.integers(5, 400)).astype(np.uint64) for _ in range(60)]
    sets = [np.unique(b[rng.random(len(b)) > rng.choice([0, 0.01, 0.05, 0.2])]) for b in base for _ in range(3)]
    size = np.array([len(s) for s in sets])
    tree = jaccard._Tree(size, [jaccard._bitmap(s) for s in sets], np.arange(1, len(sets) + 1))
    u, v = jaccard.traverse(tree, tree, 0.9)
    kept = {(min(p), max(p)) for p in zip(u.tolist(), v.tolist())}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if shared >= 0.9 * (size[a] + size[b] - shared):
                assert (a, b) in kept
    assert len(kept) < len(sets) * 10
    half = len(sets) // 2
    trees = [jaccard._Tree(size[p], [jaccard._bitmap(sets[k]) for k in p], p + 1) for p in (np.arange(half), np.arange(half, len(sets)))]
    u, v = jaccard.traverse(*trees, 0.9)
    assert {(a, b) for a, b in kept if a < half <= b} <= {(int(a), int(b) + half) for a, b in zip(u, v)}


def test_components_are_not_compared_again():
    sets = [np.arange(1, 200, dtype=np.uint64) << np.uint64(21)] * 50
    tree = jaccard._Tree(np.full(50, 199), [jaccard._bitmap(s) for s in sets], np.full(50, 7))
    assert len(jaccard.traverse(tree, tree, 0.9)[0]) == 0


def test_groups_that_span_batches():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(1, 1 << 62, 100).astype(np.uint64)) for _ in range(4)]
    rows = [(bucket, 0, 0, 0, 10 * k + c, 10 * k + c, 100, jaccard._bitmap(sets[k]).tobytes()) for bucket in range(5) for k in range(4) for c in range(2)]
    table = pa.table(dict(zip(["hub", "i", "j", "block", "node", "root", "n", "bitmap"], map(list, zip(*rows)))))
    whole = [x for b in jaccard._candidates(0.9)(table.to_batches()) for x in zip(*(c.to_pylist() for c in b.columns))]
    cut = [x for b in jaccard._candidates(0.9)(table.to_batches(max_chunksize=3)) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(whole) == sorted(cut) == sorted((10 * k, 10 * k + 1) for _ in range(5) for k in range(4))


def test_forest_has_the_greatest_weight():
    draw = random.Random(2)
    for _ in range(200):
        n = draw.randint(1, 12)
        edges = [(draw.randrange(n), draw.randrange(n), draw.random()) for _ in range(draw.randint(0, 40))]
        edges = [e for e in edges if e[0] != e[1]]
        parent, want = list(range(n)), set()

        def find(x):
            return x if parent[x] == x else find(parent[x])

        for k in sorted(range(len(edges)), key=lambda k: -edges[k][2]):
            a, b = find(edges[k][0]), find(edges[k][1])
            if a != b:
                parent[a] = b
                want.add(k)
        got = jaccard.forest(*(np.array([e[k] for e in edges], (np.int64, np.int64, float)[k]) for k in range(3)))
        assert set(got.tolist()) == want


def test_a_crowd_gives_fewer_pairs_than_classes(spark):
    """5,000 near copies of one text, most pairs of which are too different."""
    draw = random.Random(12)
    base = [f"w{draw.randrange(10**6)}" for _ in range(170)]
    texts = []
    for k in range(5000):
        words = list(base)
        for at in draw.sample(range(5, 170), draw.choice([1, 2, 2, 3])):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("key", F.xxhash64("text"))
    join = jaccard._Join(docs, 3, 0.9, jaccard.BLOCK, jaccard.FREQUENT)
    members = join.members()
    first = join.verified(join.stars(members))
    roots = jaccard.components(first)
    sparse = join.rest(members, roots.withColumnRenamed("node", "node_name"), True)
    # A class is in a forest once for each of its blocks' partners; all pairs would be millions.
    assert 0 < sparse.count() < 5 * len(texts)


def test_missing_ids_and_empty_table(spark):
    long = " ".join(map(str, range(60)))
    rows = [(None, long), (5, long + " 60"), (5, long + " 60"), (None, long + " 60 61"), (None, "alone"), (5, "other text"), (3, "OTHER   text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similarity_join(df).collect()))
    assert got == sorted([("None", 56, "5"), ("5", 57, "5"), ("5", 57, "5"), ("None", 58, "5"), ("None", 1, "None"), ("5", 1, "3"), ("3", 1, "3")])
    nameless = spark.createDataFrame([(None, long), (None, long + " 60")], "doc_id long, text string")
    assert [r.component_id for r in jaccard.similarity_join(nameless).collect()] == [None, None]
    assert jaccard.similarity_join(df.limit(0)).count() == 0


def test_later_parts_work_on_new_links_only(spark, monkeypatch):
    """The first part links long chains; what the others add costs a few tables, not all rounds anew."""
    draw = random.Random(4)
    texts = []
    for _ in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            texts.append(" ".join(words))
            words = list(words)
            words[draw.randrange(5, 120)] = f"x{draw.randrange(10**6)}"
    docs = list(enumerate(texts))
    written = []
    monkeypatch.setattr(graph, "keep", lambda df, f=graph.keep: written.append(1) or f(df))
    assert joined(spark.createDataFrame(docs, "doc_id long, text string"), size=3, threshold=0.9) == brute.similar(docs, 3, 0.9)
    assert len(written) <= 35


def test_components_with_more_edges(spark):
    draw = random.Random(6)
    for n, first, more in ((40, 25, 20), (40, 0, 20), (40, 25, 0), (10, 60, 10)):
        edges = [(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}") for _ in range(first + more)]
        one, two, whole = (spark.createDataFrame(e, "a string, b string") for e in (edges[:first], edges[first:], edges))
        got = {r.node: r.root for r in graph.extended(graph.components(one), two).collect()}
        want = {r.node: r.root for r in graph.components(whole).collect()}
        assert got.keys() == want.keys() and all(got[r] == r for r in got.values())
        assert len({(got[x], want[x]) for x in got}) == len(set(got.values())) == len(set(want.values()))
