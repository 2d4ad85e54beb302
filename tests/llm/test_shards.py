import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablekit.llm import shards
from tablekit.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute(rows, dims, n, whole):
    """The same tree by sorting: rows are (coordinates, hash, row, size); gives the shard of each row."""
    out = {}
    spread = [max(r[0][k] for r in rows) - min(r[0][k] for r in rows) for k in range(dims)] if rows else []

    def split(held, first, count):
        if count == 1 or not held:
            out.update({r[2]: first for r in held})
            return
        wide = [(max(r[0][k] for r in held) - min(r[0][k] for r in held)) / spread[k] if spread[k] else 0.0 for k in range(dims)]
        dim, left = wide.index(max(wide)), count // 2
        held = sorted(held, key=lambda r: (r[0][dim], r[1], r[2]))
        target, below = sum(r[3] for r in held) * left / count, 0
        at = 0
        while below + held[at][3] < target:
            below += held[at][3]
            at += 1
        same = [k for k, r in enumerate(held) if (r[0][dim], r[1]) == (held[at][0][dim], held[at][1])]
        group = sum(held[k][3] for k in same)
        if group <= whole:
            before = sum(r[3] for r in held[: same[0]])
            cut = same[-1] + 1 if target - before > group / 2 else same[0]
        else:
            cut = at + 1 if target - below > held[at][3] / 2 else at
        split(held[:cut], first, left)
        split(held[cut:], first + left, count - left)

    split(rows, 0, n)
    return out


def compare(spark, docs, dims, n, bins, whole=shards.WHOLE, tmp=None):
    found = shards.points(docs, dims, id="doc_id", text="text", extra=[])
    rows = [(tuple(r[f"d{k}"] for k in range(len(dims))), r["hash"], r["row"], r["size"]) for r in found.collect()]
    heavy = whole * sum(r[3] for r in rows) / n
    expected = brute(rows, len(dims), n, heavy)
    tree = shards._Tree(found, len(dims), n, heavy, bins)
    if rows:
        tree.grow()
    assert {r["row"]: r["node"] for r in tree.placed.collect()} == expected
    return expected


@pytest.mark.parametrize("n, bins", [(5, 64)])
def test_tree_equals_sorting(spark, n, bins):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    compare(spark, docs, {"length": F.log2(F.col("n_chars") + 1.0), "source": F.col("source"), "lang": F.col("lang")}, n, bins)


def test_ties_nulls_repeated_rows_and_copies(spark):
    draw = random.Random(5)
    rows = [(k if k % 7 else None, draw.choice([None, "", "a copy", "a copy", "é" * draw.randint(0, 50)]), draw.choice([None, 1.0, 2.0, float("nan"), float("inf")])) for k in range(300)]
    rows += [(1, "same text of one group", 1.0)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, age double").repartition(3)
    for n in (8,):
        compare(spark, docs, ["age"], n, 64)
    got = shards.shard(docs, ["age"], shards=8, block_bits=3).collect()
    check(got, [(r[0], r[1]) for r in rows], 8)


def check(got, rows, n):
    size = lambda t: len((t or "").encode()) + 1
    expected = sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == expected
    slots, bytes_of = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        bytes_of[r["shard"]] += r["size"]
    assert set(slots) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(bytes_of.values()), max(size(t) for _, t in rows)
    assert all(abs(bytes_of[s] - total / n) <= 2 * largest + total / n / 64 for s in range(n))


def test_query(spark):
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    got = QUERIES["op11_sharding"](spark, DATA)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = got.collect()
    check(got, [(r["doc_id"], r["text"]) for r in rows], 8)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    # Equal texts lie together, but for groups that a cut has to go through.
    text, places = {r["doc_id"]: r["text"] for r in rows}, defaultdict(set)
    for r in got:
        places[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(p) > 1 for p in places.values()) <= 7


def test_target_bytes_and_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * 99, k % 10, f"n{k}") for k in range(100)], "doc_id long, text string, age int, shardless string")
    placed = shards.shard(docs, ["age"], target_bytes=2500, extra=["text", "shardless"])
    assert placed.groupBy("shard").agg(F.sum("size")).collect().__len__() == 4
    shards.write(placed, f"{tmp_path}/out", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "shardless").collect()) == sorted((k, "x" * 99, f"n{k}") for k in range(100))


def test_empty_table_and_wrong_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, age int, size int, row int, hash int")
    assert shards.shard(docs, ["age"], shards=8).collect() == []
    assert shards.shard(docs, ["age"], target_bytes=10).collect() == []
    with pytest.raises(ValueError):
        shards.shard(docs, ["age"])
    one = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, age int")
    assert len(shards.shard(one, ["age"], shards=4).collect()) == 1
