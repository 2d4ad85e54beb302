"""Token ids packed into rows of one length.

Each task encodes its own documents, splits those beyond the row length without loss and packs the sequences of one group
after another by best fit, longest first: a segment tree over the free capacities gives the fullest row that still has
room. Nothing is shuffled; a task holds one group of bounded size.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .byte_pairs import PATTERN, ordinary
from .words import slices

ROW_TOKENS = 2048
#: Tokens that a task gathers before it packs them.
GROUP_TOKENS = 1 << 22


class Capacities:
    """Open rows by their free capacity, with a segment tree over the capacities that have any."""

    def __init__(self, largest: int):
        self.leaves = 1 << (largest + 1).bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(largest + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.leaves
        while at and not self.tree[at]:
            self.tree[at] = True
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the least capacity of at least ``need`` and the latest row that has it."""
        at = need + self.leaves
        while not self.tree[at]:
            while at & 1:  # the last below its parent: go up
                at //= 2
            if at == 0:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.tree[at] = False
            while at > 1 and not self.tree[at ^ 1]:
                at //= 2
                self.tree[at] = False
        return capacity, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The numbers of the sequences in each row. Equal lengths keep their order; no length may exceed ``capacity``."""
    rows: list[list[int]] = []
    free = Capacities(capacity)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = free.take(lengths[i])
        left, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if left > lengths[i]:
            free.add(left - lengths[i], row)
    return rows


@functools.lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), max(table.values()) + 1


def _packed(group: list, length: int, pad: int, kind: str, id_type: pa.DataType) -> pa.RecordBatch:
    """``group``: (id, place of the sequence's first token in its document, ids)."""
    out = {n: [] for n in ("n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions")}
    for row in best_fit_decreasing([len(ids) for _, _, ids in group], length):
        held = [group[i] for i in row]
        sizes = [len(ids) for _, _, ids in held]
        matrix = np.full(length, pad, kind)
        matrix[: sum(sizes)] = np.concatenate([ids for _, _, ids in held])
        positions = np.zeros(length, "<i4")
        positions[: sum(sizes)] = np.concatenate([np.arange(n) for n in sizes])
        out["n_tokens"].append(sum(sizes))
        out["doc_ids"].append([i for i, _, _ in held])
        out["starts"].append([s for _, s, _ in held])
        out["cu_seqlens"].append(np.cumsum([0, *sizes], dtype=np.int32))
        out["ids"].append(matrix.tobytes())
        out["positions"].append(positions.astype(kind if length <= 65536 else "<i4").tobytes())
    types = [pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def pack(
    docs: DataFrame, ranks: bytes, *, pattern: str = PATTERN, id: str = "doc_id", text: str = "text",
    row_tokens: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Packed rows of ``row_tokens`` ids.

    ``ranks`` is the content of a rank file. Every text's ids are followed by an end id, the first beyond the ranks. A row has
    ``n_tokens``; ``doc_ids`` and ``starts``, the document of each sequence and the place of its first token there;
    ``cu_seqlens``, where sequences begin and the last one ends; ``ids``, one row of the matrix as little-endian integers of
    16 bits (32 with larger ids), filled up with the end id; and ``positions`` in the same form, which begin at 0 in each sequence.
    Null and empty texts have only their end id; texts of any length and with any run of blanks are taken whole. Repeated rows are packed as often as they occur, rows without id with a null
    in ``doc_ids``. Other columns are not read. An empty table gives no rows. Which documents share a row depends on how the
    input is partitioned; that every token occurs once, in order, does not.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    named = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        encoder, end = _encoder(held.value, pattern)
        kind = "<u2" if end < 65536 else "<i4"
        group, size, id_type = [], 0, None
        for batch in slices(batches, "text"):
            id_type = batch.column("id").type
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                found = [] if not value else ordinary(encoder, value) if pattern == PATTERN else encoder.encode_ordinary(value)
                ids = np.array([*found, end], kind)
                for start in range(0, len(ids), row_tokens):
                    group.append((key, start, ids[start : start + row_tokens]))
                size += len(ids)
                if size >= group_tokens:
                    yield from _rows(_packed(group, row_tokens, end, kind, id_type))
                    group, size = [], 0
        if group:
            yield from _rows(_packed(group, row_tokens, end, kind, id_type))

    schema = f"n_tokens int, doc_ids array<{dict(named.dtypes)['id']}>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"
    return named.mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, n: int = 512):
    return (batch.slice(a, n) for a in range(0, batch.num_rows, n))
