import pandas as pd
import pytest
from pyspark.sql import functions as F

import tablekit as tk
from conftest import rows
from tablekit.errors import ColumnNotFound, EmptyInput, InvalidParameter

I = tk.INDEX


def names(df):
    return [r[0] for r in df.select("name").orderBy(I).collect()]


@pytest.mark.parametrize("condition,expected", [
    (("age", "=", 27), ["Bob", "Eve"]), (("age", "==", None), []), (("age", "!=", 27), ["Ann", "Cora", "Dov", "Ann"]),
    (("age", "not_equals", None), ["Ann", "Bob", "Cora", "Dov", "Eve", "Ann"]),
    (("score", ">", 80.0), ["Ann", "Dov", "Eve"]), (("score", ">=", 90.5), ["Ann", "Eve"]),
    (("score", "<", 90.5), ["Bob", "Dov"]), (("score", "<=", 71.0), ["Bob"]),
    (("name", "contains", "^[AB]"), ["Ann", "Bob", "Ann"]), (("status", "contains", "n"), ["Bob"]),
    (("status", "not_contains", "active"), ["Dov", "Ann"]), (("name", "starts_with", "C"), ["Cora"]),
    (("name", "ends_with", "v"), ["Dov"]), (("age", "in", [27, 45]), ["Bob", "Cora", "Eve"]),
    (("status", "in", ["idle", None]), ["Dov", "Ann"]), (("status", "not_in", ["active"]), ["Bob", "Dov", "Ann"]),
    (("status", "not_in", ["active", None]), ["Bob", "Ann"]), (("age", "in", 45), ["Cora"]),
    (("score", "is_null",), ["Cora", "Ann"]), (("score", "is_not_null",), ["Ann", "Bob", "Dov", "Eve"]),
    (("note", "in", [None]), ["Ann", "Cora"]),
])
def test_every_operator(people, condition, expected):
    assert names(tk.filter_rows(people, [condition])) == expected


def test_values_of_another_kind(spark):
    import datetime
    df = spark.createDataFrame(
        [(0, "5", 5, True, datetime.datetime(2024, 1, 2)), (1, "x", 1, False, datetime.datetime(2024, 3, 1))],
        f"{I} long, s string, n long, b boolean, t timestamp_ntz")
    found = lambda *c: [r[I] for r in tk.filter_rows(df, [c]).orderBy(I).collect()]
    assert found("s", "=", 5) == [] and found("n", "=", "5") == [] and found("s", "!=", 5) == [0, 1]
    assert found("n", "=", True) == [1] and found("b", "=", 1) == [0] and found("b", "=", False) == [1] and found("b", "<", 1) == [1]
    assert found("s", "in", [5, "x"]) == [1] and found("s", "not_in", [5]) == [0, 1] and found("n", "in", ["5"]) == []
    assert found("t", ">", datetime.datetime(2024, 2, 1)) == [1] and found("t", "=", "2024-01-02") == [0]
    assert found("t", "<=", datetime.date(2024, 1, 2)) == [0]
    for wrong in (("s", ">", 3), ("n", "<", "3"), ("t", ">", 4), ("s", "<", None)):
        with pytest.raises(InvalidParameter):
            found(*wrong)


def test_modes_and_counts(people):
    both = [("age", ">", 27), ("status", "=", "active")]
    assert names(tk.filter_rows(people, both)) == ["Ann", "Cora"]
    assert names(tk.filter_rows(people, [("age", "<", 28), ("score", ">", 90.0)], "or")) == ["Ann", "Bob", "Eve"]
    assert tk.filter_rows(people, []).count() == 6 and tk.filter_rows(people, [], "or").count() == 0
    assert tuple(tk.filter_counts(people, both).first()) == (6, 2, 4)
    assert tk.filter_rows(people, [tk.Condition("age", "=", 27), {"column": "name", "operator": "=", "value": "Eve"}]).count() == 1


def test_filter_errors(people):
    with pytest.raises(ColumnNotFound):
        tk.filter_rows(people, [("nope", "=", 1)])
    with pytest.raises(InvalidParameter):
        tk.filter_rows(people, [("age", "~", 1)])
    with pytest.raises(InvalidParameter):
        tk.filter_rows(people, [("name", "contains", "(")])
    with pytest.raises(InvalidParameter):
        tk.filter_rows(people, [], "xor")


def test_sort_puts_missing_values_last_in_both_directions(people):
    assert [r["score"] for r in tk.sort_data(people, ["score"]).collect()] == [71.0, 88.0, 90.5, 96.25, None, None]
    assert [r["score"] for r in tk.sort_data(people, [("score", False)]).collect()] == [96.25, 90.5, 88.0, 71.0, None, None]
    top = tk.sort_data(people, ["age", {"column": "name", "ascending": False}], limit=2).collect()
    assert [r["name"] for r in top] == ["Eve", "Bob"]
    again = tk.sort_data(people, [("age", False)], renumbered=True)
    assert names(again) == ["Cora", "Ann", "Ann", "Bob", "Eve", "Dov"] and again.agg(F.max(I)).first()[0] == 5
    with pytest.raises(ColumnNotFound):
        tk.sort_data(people, ["nope"])


@pytest.mark.parametrize("keep", ["first", "last", "none"])
@pytest.mark.parametrize("subset", [["a"], ["a", "b"], None])
def test_duplicates_equal_pandas(spark, keep, subset):
    data = [(1, "x", 1.0), (1, "x", 1.0), (None, "x", 2.0), (None, "x", 3.0), (2, None, 3.0), (2, None, 3.0), (3, "y", None), (1, "z", 1.0)]
    pdf = pd.DataFrame(data, columns=["a", "b", "c"])
    want = pdf.drop_duplicates(subset=subset, keep=False if keep == "none" else keep).index.tolist()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"{I} long, a long, b string, c double").repartition(4)
    got = tk.remove_duplicates(df, subset, keep)
    check_kept(got, data, want)


def check_kept(got, data, want):
    assert sorted(r[I] for r in got.collect()) == want
    assert {r[I]: (r["a"], r["b"], r["c"]) for r in got.collect()} == {i: data[i] for i in want}


@pytest.mark.parametrize("keep", ["first", "last", "none"])
def test_duplicates_by_hash_equal_the_direct_way(spark, keep):
    # 5 % copies: one value many times, some pairs, nulls, and keys that differ only in which column is null
    data = [(i, float(i), f"s{i}") for i in range(400)] + [(1, 1.0, "s1")] * 15 + [(7, 7.0, "s7"), (None, 2.0, "a"), (2, None, "a"), (None, 2.0, "a")]
    want = pd.DataFrame(data).drop_duplicates(keep=False if keep == "none" else keep).index.tolist()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"{I} long, a long, b double, c string").repartition(4)
    got = tk.remove_duplicates(df, None, keep, broadcast_rows=0)
    check_kept(got, data, want)
    check_kept(tk.remove_duplicates(df, ["a", "b"], keep, broadcast_rows=0), data, want)
    assert tuple(tk.duplicate_count(df).first()) == (419, 17)


def test_many_copies_take_the_direct_way(spark):
    df = spark.range(300).select(F.col("id").alias(I), (F.col("id") % 3 * F.col("id") % 5).alias("a"))
    assert tk.remove_duplicates(df, broadcast_rows=0).count() == df.select("a").distinct().count()


def test_duplicates_need_an_order_only_when_rows_differ(people):
    with pytest.raises(InvalidParameter):
        tk.remove_duplicates(people.drop(I), ["age"])
    assert tk.remove_duplicates(people.select("age", "status")).count() == 6
    with pytest.raises(InvalidParameter):
        tk.remove_duplicates(people, keep="some")


def test_nan_and_null_are_duplicates(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (-0.0,)], "v double")
    assert tk.remove_duplicates(df).count() == 2
    assert tuple(tk.duplicate_count(df).first()) == (4, 2)


def test_lookups(people):
    addresses = people.sparkSession.createDataFrame(
        [(0, "name"), (1, "age"), (2, "score"), (9, "age"), (1, "nope"), (-1, "nope")], f"{I} long, column string")
    assert rows(tk.lookup_cells(people, addresses), I, "column", "value", "type") == [
        (0, "name", "Ann", "string"), (1, "age", "27", "bigint"), (2, "score", None, "double")]
    assert rows(tk.bad_addresses(people, addresses), I, "column", "reason") == [
        (-1, "nope", "row out of range"), (1, "nope", "column not found"), (9, "age", "row out of range")]
    assert rows(tk.lookup_rows(people, [4, 1], ["name"]), I, "name") == [(1, "Bob"), (4, "Eve")]
    assert tk.lookup_rows(people, addresses.select(I)).count() == 3
    assert rows(tk.column_slice(people, "age", 1, 3), I, "age") == [(1, 27), (2, 45)]
    assert tk.column_slice(people, "age", 4).count() == 2
    for start, end in ((-3, 2), (2, 2), (3, 1), (6, None)):
        with pytest.raises(InvalidParameter):
            tk.column_slice(people, "age", start, end)


def test_column_numbers_are_addresses_too(people):
    numbers = people.sparkSession.createDataFrame([(0, 0), (1, 1), (1, 9)], f"{I} long, column int")
    assert rows(tk.lookup_cells(people, numbers), I, "column", "value") == [(0, "name", "Ann"), (1, "age", "27")]
    assert rows(tk.bad_addresses(people, numbers), I, "reason") == [(1, "column not found")]


def test_patches(people):
    patches = people.sparkSession.createDataFrame(
        [(0, "age", "40", 1), (0, "age", "41", 2), (1, "score", "bad", 1), (2, "name", None, 1), (5, "score", "1.5", 1), (7, "age", "1", 1)],
        f"{I} long, column string, value string, seq int")
    got = tk.patch_cells(people, patches)
    assert got.columns == people.columns and got.schema.simpleString() == people.schema.simpleString()
    assert [r["age"] for r in got.orderBy(I).collect()] == [41, 27, 45, None, 27, 31]
    assert [r["score"] for r in got.orderBy(I).collect()] == [90.5, None, None, 88.0, 96.25, 1.5]
    assert [r["name"] for r in got.orderBy(I).collect()][2] is None
    assert rows(tk.patch_report(people, patches), I, "column", "old_value", "new_value") == [
        (0, "age", "31", "41"), (1, "score", "71.0", None), (2, "name", "Cora", None), (5, "score", None, "1.5")]


@pytest.mark.parametrize("at,expected", [(0, "XYABCDEA"), (2, "ABXYCDEA"), (6, "ABCDEAXY"), (-1, "ABCDEAXY")])
def test_insert(people, at, expected):
    new = people.sparkSession.createDataFrame([(10, "Yan"), (3, "Xi")], f"{I} long, name string")
    got = tk.insert_rows(people, new, at).orderBy(I).collect()
    assert "".join(r["name"][0] for r in got) == expected
    assert [r[I] for r in got] == list(range(8))
    assert [r["age"] for r in got if r["name"] in ("Xi", "Yan")] == [None, None]


def test_insert_errors_and_json(people):
    spark = people.sparkSession
    with pytest.raises(InvalidParameter):
        tk.insert_rows(people, people.limit(1), 7)
    with pytest.raises(ColumnNotFound):
        tk.insert_rows(people, spark.createDataFrame([(0, 1)], f"{I} long, extra int"))
    lines = spark.createDataFrame([(0, '{"name": "Zoe", "age": 3}')], f"{I} long, json string")
    last = tk.insert_rows(people, tk.rows_from_json(lines, people)).orderBy(F.desc(I)).first()
    assert (last[I], last["name"], last["age"], last["note"]) == (6, "Zoe", 3, None)


def test_delete(people):
    for gone in ([1, 3], people.sparkSession.createDataFrame([(1,), (3,)], f"{I} long")):
        got = tk.delete_rows(people, gone).orderBy(I).collect()
        assert [(r[I], r["name"]) for r in got] == [(0, "Ann"), (1, "Cora"), (2, "Eve"), (3, "Ann")]
    assert tk.delete_rows(people, []).count() == 6
    for wrong in (-1, 6):
        for gone in ([1, wrong], people.sparkSession.createDataFrame([(1,), (wrong,)], f"{I} long")):
            with pytest.raises(InvalidParameter):
                tk.delete_rows(people, gone)


def test_find_cells(spark, people):
    assert rows(tk.find_cells_with_value(people, "Ann"), I, "column", "value") == [(0, "name", "Ann"), (5, "name", "Ann")]
    assert rows(tk.find_cells_with_value(people, 27), I, "column") == [(1, "age"), (4, "age")]
    assert tk.find_cells_with_value(people, "27").count() == 0
    assert rows(tk.find_cells_with_value(people, None, ["score", "status"]), I, "column") == [(2, "score"), (3, "status"), (5, "score")]
    assert rows(tk.find_cells_with_value(people, "ACT", exact_match=False), I) == [(0,), (1,), (2,), (4,)]
    assert rows(tk.find_cells_with_value(people, 31, exact_match=False), I) == [(0,), (5,)]
    flags = spark.createDataFrame([(0, True, 1), (1, False, 0)], f"{I} long, b boolean, n int")
    assert rows(tk.find_cells_with_value(flags, True), I, "column") == [(0, "b"), (0, "n")]
    assert rows(tk.find_cells_with_value(flags, 0), I, "column") == [(1, "b"), (1, "n")]
    with pytest.raises(ColumnNotFound):
        tk.find_cells_with_value(people, 1, ["nope"])


def test_inspect(people):
    got = tk.inspect_data_around(people, 0, "age", 1)
    assert got.columns == [I, "name", "age", "score"] and got.count() == 2
    assert tk.inspect_data_around(people, 3, 4, 10).count() == 6 and tk.inspect_data_around(people, 100, 0).count() == 0
    centres = people.sparkSession.createDataFrame([(0,), (5,)], "centre long")
    assert rows(tk.inspect_data_around_many(people, centres, "name", 1), "centre", I) == [(0, 0), (0, 1), (5, 4), (5, 5)]
    with pytest.raises(InvalidParameter):
        tk.inspect_data_around(people, 0, 9)
    with pytest.raises(ColumnNotFound):
        tk.inspect_data_around(people, 0, "nope")


def test_csv_types_tokens_and_headers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name,score,flag,code,empty\n1,"Ann, A",2.5,True,007,\n2,N/A,nan,false,x,\n3,"say ""hi""",4,TRUE,,NULL\n')
    got = tk.read_csv(spark, str(path))
    assert dict(got.dtypes) == {I: "bigint", "id": "bigint", "name": "string", "score": "double", "flag": "boolean", "code": "string", "empty": "string"}
    assert rows(got, I, "id", "name", "score", "flag", "code", "empty") == [
        (0, 1, "Ann, A", 2.5, True, "007", None), (1, 2, None, None, False, "x", None), (2, 3, 'say "hi"', 4.0, True, None, None)]
    plain = tk.read_csv(spark, str(path), header="none")
    assert plain.columns == [I, *[f"Column_{i}" for i in range(6)]] and plain.count() == 4
    later = tk.read_csv(spark, str(path), header="row", header_row=1)
    assert later.columns[:3] == [I, "1", "Ann, A"] and rows(later, I, "1") == [(0, 2), (1, 3)]


def test_csv_loses_nothing(spark, tmp_path):
    def read(text, **options):
        (tmp_path / "x.csv").write_text(text)
        return tk.read_csv(spark, str(tmp_path / "x.csv"), **options)

    ragged = read("report of may\nid,name,city\n1,ann,oslo\n2,bob\n", header="row", header_row=1)
    assert rows(ragged, I, "id", "name", "city") == [(0, 1, "ann", "oslo"), (1, 2, "bob", None)]
    assert rows(read('id,note\n1,"two\n\nlines"\n2,5" pipe\n3,"a ""b"""\n'), "id", "note") == [(1, "two\n\nlines"), (2, '5" pipe'), (3, 'a "b"')]
    for text in ("id,name\n1,ann\n2,bob,SURPLUS\n", 'id,name\n1,"a\nb",c\n'):
        with pytest.raises(InvalidParameter):
            read(text)
    assert read("id,id,id.1\n1,2,3\n").columns == [I, "id", "id.2", "id.1"]
    assert rows(read('"a\nb";c\n1;2\n', delimiter=";"), "a\nb", "c") == [(1, 2)]
    assert rows(read("a\tb\n1\tx y\n", delimiter="\t"), "a", "b") == [(1, "x y")]
    assert rows(read("a|b\n1|x,y\n", delimiter="|"), "a", "b") == [(1, "x,y")]


def test_csv_of_many_files_keeps_file_order(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part-{f}.csv").write_text("comment;\nk;v\n" + "".join(f"{f * 100 + i};{i * 'x'}\n" for i in range(3 + f * 20)))
    got = tk.read_csv(spark, str(tmp_path), delimiter=";", header="row", header_row=1).orderBy(I).collect()
    assert [r["k"] for r in got] == [*range(3), *range(100, 123), *range(200, 243)]
    assert [r[I] for r in got] == list(range(69))


def test_csv_errors_and_encoding(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("id,name,value\n")
    with pytest.raises(EmptyInput):
        tk.read_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "latin.csv").write_bytes("n\nJos\xe9\n".encode("latin-1"))
    assert tk.read_csv(spark, str(tmp_path / "latin.csv"), encoding="ISO-8859-1").first()["n"] == "José"
    with pytest.raises(InvalidParameter):
        tk.read_csv(spark, str(tmp_path / "latin.csv"), header="maybe")
    (tmp_path / "three.csv").write_text("n\n1\n2\n3\n")
    with pytest.raises(InvalidParameter):
        tk.read_csv(spark, str(tmp_path / "three.csv"), max_rows=2)
    assert tk.read_csv(spark, str(tmp_path / "three.csv"), max_rows=3).count() == 3


def test_parquet_index_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 50).coalesce(1).write.parquet(path)
    spark.range(50, 80).coalesce(1).write.mode("append").parquet(path)
    got = tk.read_parquet(spark, path).orderBy(I).collect()
    assert [r[I] for r in got] == list(range(80))
    halves = [[r["id"] for r in got[:30]], [r["id"] for r in got[:50]]]
    assert halves[0] == list(range(50, 80)) or halves[1] == list(range(50))
    assert tk.read_parquet(spark, path, row_index=False).columns == ["id"]


def test_preview(people):
    got = tk.preview(people, 2)
    assert rows(got, I, "name", "total_rows", "total_columns", "truncated") == [(0, "Ann", 6, 5, True), (1, "Bob", 6, 5, True)]
    assert tk.preview(people, 10).first()["truncated"] is False


def test_lines_in_a_column(spark):
    lines = spark.createDataFrame([(1, "2;x"), (2, ";y")], "k int, line string")
    assert rows(tk.parse_csv_column(lines, "line", "n long, s string", ";"), "k", "n", "s") == [(1, 2, "x"), (2, None, "y")]


def test_row_wise_operators_run_on_a_stream(spark, people, tmp_path):
    path = str(tmp_path / "in")
    people.write.parquet(path)
    stream = spark.readStream.schema(people.schema).parquet(path)
    out = tk.filter_rows(stream, [("age", ">", 20), ("name", "contains", "[A-Z]")])
    out = tk.transform_column_case(tk.replace_in_column(out, "name", "n+", "N"), "status", "upper")
    out = tk.change_column_type(tk.add_column(out, "k", formula="age * 2"), "k", "str")
    query = out.writeStream.format("memory").queryName("streamed").outputMode("append").start()
    try:
        query.processAllAvailable()
        assert rows(spark.table("streamed"), I, "name", "status", "k")[0] == (0, "AN", "ACTIVE", "62")
    finally:
        query.stop()


def test_large_address_tables_are_not_broadcast(spark, people):
    from tablekit.plans.joins import bounded
    ids = spark.range(50)
    assert bounded(ids, 49) is ids and bounded(ids, 50) is not ids
