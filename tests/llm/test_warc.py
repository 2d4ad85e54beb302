import base64
import hashlib
import os

import pyarrow.parquet as pq
import pytest
import zstandard

from tablekit.llm import warc
from tablekit.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def expected(pages, min_bytes=0):
    payload = lambda h: (h or "").encode()
    first = {}
    for key, html in pages:
        if key is not None:
            first[payload(html)] = min(first.get(payload(html), key), key)
    out = []
    for key, html in pages:
        p = payload(html)
        to = first.get(p) if len(p) >= min_bytes and first.get(p) != key else None
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((key, len(p), digest, "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_whole_table(spark):
    pages = [(r["page_id"], r["html"]) for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist()]
    got = QUERIES["op8_warc"](spark, DATA)
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages)


PAGES = [(5, "u", "<p>é"), (3, "u\r\nx", "<p>é"), (9, None, None), (8, "u", ""), (8, "u", ""), (None, "v", "<p>é"), (None, "v", "alone"),
         (20, "long", "ab" * 500_000), *((100 + k, "hot", "x" * 40) for k in range(60))]


@pytest.fixture()
def written(spark, tmp_path):
    df = spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id long, url string, html string, sha1 string, first int").repartition(3)
    path = str(tmp_path / "archive")
    warc.write(df, path, frame_bytes=600, bundle_bytes=1500)
    return path


def test_edge_cases(spark, written):
    rows = warc.read(spark, written).collect()
    got = sorted(((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in rows), key=str)
    assert got == expected([(k, h) for k, _, h in PAGES])
    texts = {r.page_id: r.payload.decode() for r in rows if r.record_type == "response"}
    assert texts["20"] == "ab" * 500_000 and texts["3"] == "<p>é" and texts["8"] == ""
    assert {r.url for r in rows if r.page_id in ("3", "9")} == {"u%0D%0Ax", None}


def test_files_are_plain_zstandard_with_a_seek_table(written):
    files = [f for f in os.listdir(written) if f.startswith("part-") and os.path.getsize(f"{written}/{f}")]
    assert len(files) > 3
    for f in files:
        data = open(f"{written}/{f}", "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert sum(n for _, _, n in warc.seek_table(data)) == len(whole)
        assert sum(size for _, size, _ in warc.seek_table(data)) + 8 + 8 * len(warc.seek_table(data)) + 9 == len(data)
        for name, _, at, size, offset, length in warc.places(data):
            frame = zstandard.ZstdDecompressor().decompress(data[at : at + size])
            assert warc.parse(frame[offset : offset + length])["WARC-Record-ID"] == name


def test_fetch_by_identifier(spark, written):
    wanted = spark.createDataFrame([(warc.record_id(k),) for k in (20, 3, 77, 100)], "record_id string")
    assert sorted(r.page_id for r in warc.fetch(spark, written, wanted).collect()) == ["100", "20", "3"]


def test_least_size_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "a"), min_bytes=10)
    got = {(r.page_id, r.record_type) for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert got == {(None if k is None else str(k), t) for k, _, _, t, _ in expected([(k, h) for k, _, h in PAGES], 10)}
    warc.write(df.limit(0), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_damage_is_found():
    data = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "d")
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"pAyload"))
