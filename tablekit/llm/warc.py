"""Web archives in seekable Zstandard bundles.

A bundle is a file of independent frames, each with some whole records; a skippable frame that maps record identifiers to a
frame, the offset inside it and the length; and the seek table of the seekable Zstandard format at the end. Spark's own
writer commits the files, so that they may lie in any store that Spark knows and a lost task leaves nothing half written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.store import keep

#: Bytes of records in a frame, and of frames in a bundle, at least.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 24
#: Digests looked up by a broadcast, because so many rows may share each of them.
HOT_DIGESTS = 1000

# Fixed values of the formats.
_SKIPPABLE, _SEEK_TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def record(key, url: str | None, payload: bytes, sha1: str, first, date: str) -> bytes:
    """One record; ``first`` is the key of the response that a revisit refers to, or None."""
    head = _HTTP.format(len(payload)).encode()
    block = head if first is not None else head + payload
    fields = {
        "WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": record_id(key), "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "X-Page-ID": json.dumps(key),
    }
    if first is not None:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(first), "X-Refers-To-Page-ID": json.dumps(first)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class Bundle:
    """Records on their way into a bundle."""

    def __init__(self, frame_bytes: int):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled, self.size, self.places = 0, 0, []

    def add(self, name: str, data: bytes) -> None:
        self.places.append((name, len(self.frames), self.filled, len(data)))
        self.open.append(data)
        self.filled += len(data)
        if self.filled >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.size += len(frame)
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self._close()
        places = self.packer.compress(json.dumps(self.places).encode())
        places = struct.pack("<II", _SKIPPABLE, len(places)) + places
        entries = [*self.sizes, (len(places), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, _SEEKABLE)
        return b"".join([*self.frames, places, struct.pack("<II", _SEEK_TABLE, len(table)), table])


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Offset, size and unpacked size of every frame before the table."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    start = len(data) - 9 - 8 * count
    if magic != _SEEKABLE or struct.unpack("<II", data[start - 8 : start]) != (_SEEK_TABLE, 8 * count + 9):
        raise ValueError("no seek table at the end of the bundle")
    out, at = [], 0
    for k in range(count):
        size, full = struct.unpack_from("<II", data, start + 8 * k)
        out.append((at, size, full))
        at += size
    return out


def places(data: bytes) -> list[tuple[str, int, int, int, int, int]]:
    """Of every record: identifier, frame, the frame's offset and size in the file, the record's offset in the frame, its length."""
    table = seek_table(data)
    at, size, _ = table[-1]
    held = json.loads(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + size]))
    return [(name, k, *table[k][:2], offset, length) for name, k, offset, length in held]


def parse(data: bytes) -> dict:
    """A record's fields, with its payload as ``payload`` and the length of the full payload as ``payload_bytes``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != fields["payload_bytes"] or "sha1:" + digest != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields | {"payload": payload}


def with_first(pages: DataFrame, *, id: str = "page_id", html: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """``id``, ``url``, ``html`` (empty for null), ``sha1`` and ``first``: for a revisit, the smallest id with the same payload.

    Payloads under ``min_bytes`` are never revisits. Only digests that occur more than once take part in the join; those of
    the most rows, ``HOT_DIGESTS`` at most, are broadcast, and their rows are spread by their ids.
    """
    named = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    named = named.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    counted = named.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = keep(counted.where("n > 1 and first is not null"))
    hot = repeated.orderBy(F.desc("n"), "sha1").limit(HOT_DIGESTS).select("sha1", F.col("first").alias("hot_first"))
    rest = repeated.join(F.broadcast(hot), "sha1", "left_anti").select(F.col("sha1").alias("key"), "first")
    marked = named.join(F.broadcast(hot), "sha1", "left").withColumn(
        "key", F.when(F.col("hot_first").isNull(), F.col("sha1")).otherwise(F.xxhash64("id").cast("string"))
    )
    first = F.coalesce("hot_first", "first")
    return marked.join(rest, "key", "left").select("id", "url", "html", "sha1", F.when(~F.col("id").eqNullSafe(first), first).alias("first"))


def write(
    pages: DataFrame, path: str, *, id: str = "page_id", html: str = "html", url: str = "url", min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """Write a record for every row of ``pages`` into bundles in the folder ``path``.

    The first record of a payload, by id, is a response and later ones revisit it. Rows that repeat the smallest id are all
    responses; rows without id may only be revisits. Null html is an empty payload, and a null url is left out. An
    empty table writes no bundle. Other columns are not read.
    """

    def bundles(batches):
        bundle = Bundle(frame_bytes)
        for batch in batches:
            for key, address, text, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                bundle.add(record_id(key), record(key, address, text.encode(), sha1, first, date))
                if bundle.size >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle.finish()], pa.binary())], ["bundle"])
                    bundle = Bundle(frame_bytes)
        if bundle.places:
            yield pa.RecordBatch.from_arrays([pa.array([bundle.finish()], pa.binary())], ["bundle"])

    rows = with_first(pages, id=id, html=html, url=url, min_bytes=min_bytes).mapInArrow(bundles, "bundle binary")
    # The text writer writes a row's bytes and then its separator: one row a file, with the bundle's last four bytes as separator.
    last = struct.pack("<I", _SEEKABLE).decode("latin-1")
    rows.select(F.expr("cast(substring(bundle, 1, length(bundle) - 4) as string)").alias("value")).write.option("lineSep", last).option(
        "encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every record is: ``record_id``, ``bundle`` (its file), ``frame``, ``frame_offset``, ``frame_size``, ``offset``, ``length``."""

    def index(batches):
        for batch in batches:
            for bundle, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                columns = list(zip(*places(content.as_py())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array([bundle] * len(columns[0])), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    ["record_id", "bundle", "frame", "frame_offset", "frame_size", "offset", "length"],
                )

    return _bundles(spark, path).mapInArrow(index, "record_id string, bundle string, frame long, frame_offset long, frame_size long, offset long, length long")


_RECORD = "record_id string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _rows(records: list[dict]) -> pa.RecordBatch:
    names = ["WARC-Record-ID", "X-Page-ID", "WARC-Target-URI", "WARC-Type", "payload_bytes", "WARC-Payload-Digest", "X-Refers-To-Page-ID", "payload"]
    columns = [[r.get(n) for r in records] for n in names]
    plain = lambda c: [None if v is None or v == "null" else str(json.loads(v)) for v in c]
    columns[1], columns[6] = plain(columns[1]), plain(columns[6])
    columns[5] = [d.removeprefix("sha1:") for d in columns[5]]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _RECORD.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles in ``path``; ids are text. The digests of responses are checked."""

    def records(batches):
        for batch in batches:
            for content in batch.column("content"):
                data, unpack = content.as_py(), zstandard.ZstdDecompressor()
                frames: dict[int, list] = {}
                for _, k, at, size, offset, length in places(data):
                    frames.setdefault(k, []).append((at, size, offset, length))
                for held in frames.values():
                    frame = unpack.decompress(data[held[0][0] : held[0][0] + held[0][1]])
                    yield _rows([parse(frame[o : o + n]) for _, _, o, n in held])

    return _bundles(spark, path).mapInArrow(records, _RECORD)


def fetch(spark: SparkSession, path: str, wanted: DataFrame, record: str = "record_id") -> DataFrame:
    """The records that ``wanted`` lists, unpacking only the frames that hold one."""
    chosen = read_index(spark, path).join(wanted.select(F.col(record).alias("record_id")).distinct(), "record_id", "left_semi")
    listed = chosen.groupBy("bundle").agg(F.collect_list(F.struct("frame_offset", "frame_size", "offset", "length")).alias("places"))

    def records(batches):
        for batch in batches:
            for content, held in zip(batch.column("content"), batch.column("places").to_pylist()):
                data, unpack, frames = content.as_py(), zstandard.ZstdDecompressor(), {}
                for p in held:
                    at = p["frame_offset"]
                    if at not in frames:
                        frames[at] = unpack.decompress(data[at : at + p["frame_size"]])
                yield _rows([parse(frames[p["frame_offset"]][p["offset"] : p["offset"] + p["length"]]) for p in held])

    held = _bundles(spark, path).join(listed, F.col("path") == F.col("bundle")).select("content", "places")
    return held.mapInArrow(records, _RECORD)
