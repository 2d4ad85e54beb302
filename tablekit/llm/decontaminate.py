"""Benchmark passages in training texts.

The windows of all benchmark items are found and grouped by a Spark job and form a hash set, of flat arrays, that every task gets. A task
rolls over the words of its documents, looks each run of words up in the set, compares the words of every hit and marks them. Only the
answers come back from the tasks' workers: texts go to them but stay in their rows. No document is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.store import keep
from .words import ALPHANUMERIC, runs, slices, text_bytes, words

WINDOW = 10
#: Bytes of windows, with their hashes and item ids, that are sent to the tasks at a time; a larger benchmark takes several passes.
SLICE_BYTES = 16 << 20


def _of_items(window: int):
    """Items to their windows: number of words, hash, the words with blanks between, and the item."""

    def of_items(batches):
        for batch in slices(batches, "text"):
            found = words(batch.column("text"), ALPHANUMERIC)
            ids, counts = batch.column("id").to_pylist(), found.counts
            for length in sorted({min(int(c), window) for c in counts if c}):
                hashes, first = runs(found, length)
                row = np.searchsorted(found.offsets, first, "right") - 1
                own = np.minimum(counts[row], window) == length
                hashes, first, row = hashes[own], first[own], row[own]
                text = [_spoken(found, i, length) for i in first.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), length, np.int32)), pa.array(hashes.view(np.int64)), pa.array(text, pa.binary()), pa.array([ids[r] for r in row.tolist()], pa.string())],
                    ["length", "hash", "words", "item"],
                )

    return of_items


def _spoken(found, first: int, length: int) -> bytes:
    return b" ".join([found.word(k) for k in range(first, first + length)])


class _Windows:
    """The windows of one slice as flat arrays, sorted by their number of words and hash."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        hashes = rows.column("hash").to_numpy().astype(np.int64).view(np.uint64)
        length = rows.column("length").to_numpy()
        order = np.lexsort((hashes, length))
        self.hashes = hashes[order]
        text = rows.column("words").take(pa.array(order)).combine_chunks().cast(pa.large_binary())
        items = rows.column("items").take(pa.array(order)).combine_chunks()
        names = items.flatten().dictionary_encode()
        text = pa.chunked_array([text]).combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        self.data = text.buffers()[2].to_pybytes() if len(text) else b""
        self.offsets = offsets.copy()
        self.item_offsets = np.append(0, np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        self.item_at = names.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.items = names.dictionary.to_pylist()
        edges = np.flatnonzero(np.diff(length[order])) + 1
        cut = [0, *edges.tolist(), len(order)] if len(order) else [0]
        self.lengths = [(int(length[order][a]), a, b) for a, b in zip(cut, cut[1:])]

    def hits(self, found) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, item ids) of every occurrence."""
        for length, low, high in self.lengths:
            known = self.hashes[low:high]
            hashes, first = runs(found, length)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for k in np.flatnonzero(known[at] == hashes).tolist():
                i, j = int(first[k]), low + int(at[k])
                text = _spoken(found, i, length)
                while j < high and self.hashes[j] == hashes[k]:
                    if self.data[self.offsets[j] : self.offsets[j + 1]] == text:
                        yield i, length, [self.items[x] for x in self.item_at[self.item_offsets[j] : self.item_offsets[j + 1]].tolist()]
                    j += 1


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_FOUND = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(_SPAN)), ("items", pa.list_(pa.string())), ("cut", pa.string())])


def _scan(held, cut: bool):
    """The occurrences of one slice of the windows, added to those of the slices before."""

    def scan(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        windows = held.value
        for text, hit, items in columns:
            batch = pa.RecordBatch.from_arrays([text, hit, items], ["text", "hit", "items"])
            done = [_found(part, windows, cut) for part in slices([batch], "text")]
            yield pa.concat_arrays(done) if done else pa.array([], _FOUND)

    return F.arrow_udf(scan, "struct<n_words:long, hit:array<struct<start:int, stop:int>>, items:array<string>, cut:string>").asNondeterministic()


def _found(batch: pa.RecordBatch, windows: _Windows, cut: bool) -> pa.Array:
    found = words(batch.column("text"), ALPHANUMERIC)
    row_of = found.rows()
    spans = {r: [(s["start"], s["stop"]) for s in x] for r, x in enumerate(batch.column("hit").to_pylist()) if x}
    items = {r: set(x) for r, x in enumerate(batch.column("items").to_pylist()) if x}
    for i, length, ids in windows.hits(found):
        r = int(row_of[i])
        start = i - int(found.offsets[r])
        spans.setdefault(r, []).append((start, start + length))
        items.setdefault(r, set()).update(ids)
    spans = {r: _union(x) for r, x in spans.items()}
    texts = _without(batch.column("text"), found, spans) if cut else {}
    n = batch.num_rows
    return pa.StructArray.from_arrays(
        [
            pa.array(found.counts, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in spans.get(r, ())] for r in range(n)], pa.list_(_SPAN)),
            pa.array([sorted(items.get(r, ())) for r in range(n)], pa.list_(pa.string())), pa.array([texts.get(r) for r in range(n)], pa.string()),
        ],
        fields=list(_FOUND),
    )


def _without(column: pa.Array, found, spans: dict[int, list[tuple[int, int]]]) -> dict[int, str]:
    """The texts of rows with spans, without the words in them and what lies between."""
    raw, bounds = text_bytes(column)
    out = {}
    for r, held in spans.items():
        base, kept, at = int(found.offsets[r]), [], int(bounds[r])
        for a, b in held:
            kept.append(raw[at : found.starts[base + a]].tobytes())
            at = int(found.ends[base + b - 1])
        out[r] = b"".join([*kept, raw[at : bounds[r + 1]].tobytes()]).decode()
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES, extra: list[str] = (), cut: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id, text, ``extra`` columns, ``n_words``, ``hit`` (spans of word positions) and ``items`` (ids as strings).

    Words are runs of digits, a-z (A-Z are folded) and non-ASCII characters. A window is ``window`` consecutive words of an
    item, or all words of a shorter one. With ``cut`` the text comes without the words that are hit and what lies between two of them. Null
    and empty texts have no words and no hits; items without words or id are
    ignored; repeated rows are judged alike; an empty benchmark hits nothing. Other columns are not read.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null")
    each = items.mapInArrow(_of_items(window), "length int, hash long, words binary, item string")
    grouped = keep(each.groupBy("length", "hash", "words").agg(F.sort_array(F.collect_set("item")).alias("items")))
    size = F.octet_length("words") + F.octet_length(F.array_join("items", ",")) + 4 * F.size("items") + 32
    n = max(1, -(-(grouped.agg(F.sum(size)).first()[0] or 0) // slice_bytes))
    nothing = {"hit": F.lit(None).cast("array<struct<start:int, stop:int>>"), "items": F.lit(None).cast("array<string>")}
    names = {f"x{k}": c for k, c in enumerate(extra)}
    out = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(x) for x, c in names.items()]).withColumns(nothing)
    for k in range(n):
        windows = _Windows(grouped.where(F.pmod("hash", F.lit(n)) == k).toArrow())
        scan = _scan(docs.sparkSession.sparkContext.broadcast(windows), cut and k == n - 1)
        out = out.withColumn("found", scan("text", "hit", "items"))
        out = out.select("id", F.coalesce("found.cut", "text").alias("text"), *names, "found.n_words", "found.hit", "found.items")
        if k < n - 1:
            out = keep(out)  # so that only one slice of the windows is in memory
    return out.select(F.col("id").alias(id), F.col("text").alias(text), *[F.col(x).alias(c) for x, c in names.items()], "n_words", "hit", "items")


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """Per document the words hit, the number of items found and their ids as one digest."""
    found = find_contamination(docs, benchmark, id=id, **options)
    hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        id, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def _removed(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, hit in columns:
        out = []
        for part in slices([pa.RecordBatch.from_arrays([text, hit], ["text", "hit"])], "text"):
            spans = {r: [(s["start"], s["stop"]) for s in x] for r, x in enumerate(part.column("hit").to_pylist()) if x}
            cut = _without(part.column("text"), words(part.column("text"), ALPHANUMERIC), spans)
            out += [cut.get(r) for r in range(part.num_rows)]
        yield pa.array(out, pa.string())


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``find_contamination`` without their hit words; what lies between two hit words goes with them."""
    removed = F.arrow_udf(_removed, "string").asNondeterministic()
    return found.withColumn(text, F.coalesce(removed(F.col(text), F.col("hit")), F.col(text)))


def remove_documents(found: DataFrame, max_share: float = 0.0) -> DataFrame:
    """Rows of ``find_contamination`` whose share of hit words is at most ``max_share``."""
    hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.where(hit <= F.lit(max_share) * F.col("n_words"))

