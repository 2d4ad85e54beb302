"""Records that quotes carry over lines and file splits."""

import csv
import io
import random

import pytest
from conftest import rows

import tablekit as tk
from tablekit.errors import InvalidParameter
from tablekit.plans.columns import INDEX as I
from tablekit.sources import files


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "290")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def written(draw, n, ends="\n"):
    """Fields with quotes, delimiters, blank lines and long runs of lines; returns the text and its records."""
    def field():
        kind = draw.random()
        if kind < 0.4:
            return draw.choice(["a", "12", "x y", "é漢", "q" * 30])
        if kind < 0.7:
            return draw.choice(['he said ""hi""', "two\nlines", "a,b", '"', "\n\n\n", "end\n", 'x"\n"y', "l\n" * draw.randint(5, 60)]).replace('""', '"')
        return draw.choice(["", "0", "z"])
    made = [[str(k), field(), field()] for k in range(n)]
    out = io.StringIO()
    csv.writer(out, lineterminator=ends).writerows([["id", "one", "two"], *made])
    return out.getvalue(), made


def null(x):
    return None if x.strip(" ") in files.NA_TOKENS else x


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_records_over_many_splits(spark, tmp_path, small_splits, ends):
    want = []
    for f in range(2):
        text, made = written(random.Random(f), 90, ends)
        (tmp_path / f"{f}.csv").write_bytes(text.encode())
        want += made
    got = tk.read_csv(spark, str(tmp_path), infer_types=False)
    assert rows(got, I, "id", "one", "two") == [(k, i, null(a), null(b)) for k, (i, a, b) in enumerate(want)]
    assert files._Lines(spark, [str(tmp_path)], "UTF-8").read().rdd.getNumPartitions() > 10


def test_a_record_over_several_splits_and_header_in_lines(spark, tmp_path, small_splits):
    long = "line\n" * 200
    (tmp_path / "a.csv").write_text(f'note\n"na\nme",b\n1,"{long}"\n"x\n",2\n3,4\n')
    got = tk.read_csv(spark, str(tmp_path), header="row", header_row=1, infer_types=False)
    assert got.columns == [I, "na\nme", "b"]
    assert rows(got, I, "na\nme", "b") == [(0, "1", long), (1, "x\n", "2"), (2, "3", "4")]
    with pytest.raises(InvalidParameter):  # the first record has one field
        tk.read_csv(spark, str(tmp_path), header="none")


@pytest.mark.parametrize("encoding", ["UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32", "UTF-8"])
@pytest.mark.parametrize("broken", [False, True])
def test_wide_encodings(spark, tmp_path, small_splits, encoding, broken):
    text, want = written(random.Random(5), 25) if broken else ("id,one,two\n1,a,é\n2,c,漢\n", [["1", "a", "é"], ["2", "c", "漢"]])
    (tmp_path / "w.csv").write_bytes(text.encode(encoding))
    got = tk.read_csv(spark, str(tmp_path), encoding=encoding, infer_types=False)
    assert rows(got, I, "id", "one", "two") == [(k, i, null(a), null(b)) for k, (i, a, b) in enumerate(want)]


def test_bytes_out_of_step_and_bare_returns(spark, tmp_path):
    text = 'id,name\n1,"ਊĀx"\n2,"a\nb"\n'  # in one byte order, a letter's second byte and the next one's first look like a line feed
    (tmp_path / "w.csv").write_bytes(text.encode("UTF-16LE"))
    lines = files._Lines(spark, [str(tmp_path)], "UTF-16LE")
    assert files._way(lines, ",") in ("whole", "records")
    assert rows(tk.read_csv(spark, str(tmp_path), encoding="UTF-16LE"), "id", "name") == [(1, "ਊĀx"), (2, "a\nb")]
    (tmp_path / "mac").mkdir()
    (tmp_path / "mac" / "m.csv").write_bytes(b'id,name\r1,x\r2,"a b"\r')
    assert rows(tk.read_csv(spark, str(tmp_path / "mac")), "id", "name") == [(1, "x"), (2, "a b")]


def test_stray_quotes_do_not_carry_over(spark, tmp_path, small_splits):
    (tmp_path / "s.csv").write_text('id,name\n1,5" pipe\n2,"two\nlines"\n3,6" pipe\n4,x\n')
    assert rows(tk.read_csv(spark, str(tmp_path)), "id", "name") == [(1, '5" pipe'), (2, "two\nlines"), (3, '6" pipe'), (4, "x")]


def test_long_quoted_fields_need_no_deep_matching(spark, tmp_path):
    (tmp_path / "l.csv").write_text('id,name\n1,"' + "x" * 300_000 + '\n' + 'y""' * 20_000 + '"\n')
    assert tk.read_csv(spark, str(tmp_path)).first()["name"] == "x" * 300_000 + "\n" + 'y"' * 20_000
