import random

import pytest
from pyspark.sql import functions as F

import tablekit as tk
from tablekit.errors import InvalidParameter
from tablekit.plans import joins
from tablekit.plans.joins import lookup_join
from tablekit.plans.order import last_before, running_sums, sums_before


def ids(spark, keys, partitions=3):
    return spark.createDataFrame([(k,) for k in keys], "k long").repartition(partitions)


@pytest.mark.parametrize("bits,keys", [
    (17, [0]), (2, [5, 3, 9]), (3, [-7, 0, 2, 3, 4, 90, 1000]), (1, list(range(40))), (4, list(range(200))),
    (17, [2**40, 3, -(2**35)]),
])
def test_renumber_gives_ranks(spark, bits, keys):
    got = {r["k"]: r["n"] for r in tk.renumber(ids(spark, keys), by="k", index="n", bits=bits).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_renumber_empty_and_wrong_type(spark, people):
    assert tk.renumber(ids(spark, [1]).filter("k > 5"), by="k").count() == 0
    with pytest.raises(InvalidParameter):
        tk.renumber(people, by="name")


def test_renumber_replaces_the_index_and_keeps_columns(spark, people):
    kept = tk.renumber(people.filter("age = 27 OR age = 31"))
    assert kept.columns == people.columns
    assert sorted((r["name"], r["__row_index__"]) for r in kept.collect()) == [("Ann", 0), ("Ann", 3), ("Bob", 1), ("Eve", 2)]


@pytest.mark.parametrize("bits", [2, 17])
def test_sums_before(spark, bits):
    rng = random.Random(1)
    data = {k: rng.randint(1, 9) for k in rng.sample(range(60), 25)}
    t = spark.createDataFrame(list(data.items()), "k long, v long")
    got = {r["k"]: r["v"] for r in sums_before(t, "k", ["v"], 59, bits).collect()}
    assert got == {k: sum(v for j, v in data.items() if j < k) for k in data}


@pytest.mark.parametrize("bits", [2, 17])
def test_last_before(spark, bits):
    rng = random.Random(2)
    data = [(k, rng.choice([None, k * 10]), rng.choice([None, None, f"s{k}"])) for k in range(30)]
    got = {r["k"]: (r["v"], r["s"]) for r in
           last_before(spark.createDataFrame(data, "k long, v long, s string"), "k", ["v", "s"], 29, bits).collect()}
    for k, *_ in data:
        known_v = [v for j, v, _ in data if j < k and v is not None]
        known_s = [s for j, _, s in data if j < k and s is not None]
        assert got[k] == (known_v[-1] if known_v else None, known_s[-1] if known_s else None)


def test_with_row_index_by_columns_and_partitions(spark):
    data = [(i, random.Random(i).choice("abc"), i % 4) for i in range(50)]
    expected = {r[0]: n for n, r in enumerate(sorted(data, key=lambda r: (r[1], -r[2], r[0])))}
    for partitions in (1, 7):
        df = spark.createDataFrame(data, "i long, a string, b long").repartition(partitions)
        got = tk.with_row_index(df, ["a", F.col("b").desc(), "i"])
        assert {r["i"]: r["__row_index__"] for r in got.collect()} == expected


def test_with_row_index_without_order_is_dense(spark):
    df = spark.range(100).repartition(6)
    got = tk.with_row_index(df).collect()
    assert sorted(r["__row_index__"] for r in got) == list(range(100))
    assert sorted(r["id"] for r in got) == list(range(100))


def test_one_key_with_most_rows_is_spread_and_exact(spark):
    # two thirds of the rows share the sort key; the row index keeps them apart
    df = spark.range(3000).select(F.col("id").alias("__row_index__"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"))
    got = tk.sort_data(df, ["k"], renumbered=True)
    pdf = df.toPandas().sort_values(["k", "__row_index__"]).reset_index(drop=True)
    assert sorted((r["__row_index__"], r["k"]) for r in got.collect()) == list(enumerate(pdf["k"]))


def test_running_sums_per_group(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 4}", i * 0.5, rng.randint(0, 5)) for i in range(400)]
    t = spark.createDataFrame(data, "g string, o double, v long").repartition(4)
    got = {(r["g"], r["o"]): (r["s"], r["r"]) for r in running_sums(t, ["g"], ["o"], {"s": "v", "r": F.lit(1)}).collect()}
    for g, o, _ in data:
        earlier = [v for g2, o2, v in data if g2 == g and o2 < o]
        assert got[g, o] == (sum(earlier), len(earlier))


def test_running_sums_without_group(spark):
    t = spark.range(57).select((F.col("id") * 3).alias("o"))
    got = {r["o"]: r["r"] for r in running_sums(t, [], ["o"], {"r": F.lit(1)}).collect()}
    assert got == {3 * i: i for i in range(57)}


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_lookup_join_with_a_hot_key(spark, how):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 50).cast("long").alias("k"))
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 2 = 0")
    expected = big.join(small, "k", how).select("id", "k")
    got = lookup_join(big, small, ["k"], "n", how)
    assert sorted(map(tuple, got.select("id", "k").collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("strategy", ["forward", "backward"])
@pytest.mark.parametrize("bits", [3, 17])
def test_neighbour_fill_equals_a_sequential_fill(spark, strategy, bits):
    rng = random.Random(7)
    data = [(i, rng.choice([None, float(i)]), rng.choice([None, None, None, f"t{i}"]), rng.choice([None, i])) for i in range(70)]
    df = spark.createDataFrame(data, "__row_index__ long, v double, s string, keep long").repartition(5)
    got = tk.fill_missing_values(df, strategy, columns=["v", "s"], block_bits=bits).orderBy("__row_index__").collect()
    for r in got:
        i = r["__row_index__"]
        near = data[i::-1] if strategy == "forward" else data[i:]
        assert r["v"] == next((x[1] for x in near if x[1] is not None), None)
        assert r["s"] == next((x[2] for x in near if x[2] is not None), None)
        assert r["keep"] == data[i][3]


@pytest.mark.parametrize("bits", [1, 2, 17])
def test_null_clusters_across_blocks(spark, bits):
    rng = random.Random(11)
    data = [(i, rng.choice([None, 1.0]), rng.choice([None, None, 1.0])) for i in range(100)]
    df = spark.createDataFrame(data, "__row_index__ long, a double, b double").repartition(4)
    got = {r["column"]: r["clusters"] for r in tk.null_clusters(df, ["a", "b"], bits=bits).collect()}
    for c, at in (("a", 1), ("b", 2)):
        runs, length = 0, 0
        for row in [*data, (None, 1.0, 1.0)]:
            if row[at] is None:
                length += 1
            else:
                runs, length = runs + (length > 1), 0
        assert got[c] == runs


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_with_a_bound_on_the_rows_of_a_task(spark, monkeypatch, how):
    """A key with half of the rows and both zeros as one key; Spark doesn't merge the small partitions again."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    key = F.when(F.col("id") % 2 == 0, F.lit(7.5)).when(F.col("id") % 9 == 0, F.lit(-0.0)).otherwise(F.col("id") % 100)
    big = spark.range(4000).select("id", key.alias("k"))
    counts = {}
    for r in big.collect():
        counts[r["k"] + 0.0] = counts.get(r["k"] + 0.0, 0) + 1
    small = spark.createDataFrame([(k, n, f"of {k}") for k, n in counts.items() if k != 99.0], "k double, n long, name string")
    got = lookup_join(big, small, ["k"], "n", how, task_rows=100)
    assert got.columns == (["k", "id"] if how == "left_semi" else ["k", "id", "n", "name"])
    want = {r["id"]: None if r["k"] == 99.0 else f"of {r['k'] + 0.0}" for r in big.collect() if how == "left" or r["k"] != 99.0}
    found = got.collect()
    assert len(found) == len(want) and {r["id"] for r in found} == set(want)
    if how != "left_semi":
        assert {r["id"]: r["name"] for r in found} == want
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(parts) > 20 and max(parts) < 400
