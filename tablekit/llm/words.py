"""Words of whole Arrow text columns as numpy arrays, without a Python object per word.

Every alphabet used here separates words by ASCII characters only, so cutting the UTF-8 bytes is the same as cutting the
characters: a byte of a longer character is never an ASCII byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
#: An odd multiplier; its powers mod 2**64 give the weight of a byte's place in a word.
_BASE = 0x9E3779B97F4A7C15


def _classes(separators: bytes, marks: bytes = b"") -> np.ndarray:
    """For each byte: 0 a separator, 2 a mark, 1 part of a word."""
    kinds = np.ones(256, np.uint8)
    kinds[list(marks)] = 2
    kinds[list(separators)] = 0
    return kinds


#: ``[^\x20\x09-\x0D]+``
BLANK_SEPARATED = _classes(b" \t\n\v\f\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased
ALPHANUMERIC = _classes(bytes(b for b in range(128) if not (chr(b).isdigit() or chr(b).islower())))
#: Runs of letters and digits, and runs of other visible characters
WORDS_AND_MARKS = _classes(bytes(range(33)) + b"\x7f", bytes(b for b in range(33, 127) if not chr(b).isalnum()))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values: a bijection whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)

        def table(base: int) -> np.ndarray:
            out, step = np.ones(1, np.uint64), base
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step & _MASK
            return out

        _POWERS, _INVERSES = table(_BASE), table(inverse)
    return _POWERS[:n], _INVERSES[:n]


@dataclass
class Words:
    """The words of a column: row ``r`` has the words ``offsets[r]`` to ``offsets[r + 1]``.

    ``data[starts[i]:ends[i]]`` are the bytes of word ``i`` and ``hashes[i]`` is their 64-bit hash.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(batches, column: str, limit: int = 1 << 20):
    """The batches cut into pieces of whole rows with about ``limit`` bytes of text, which bounds a worker's memory."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one buffer, and each row's start in it; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(column: pa.Array, kinds: np.ndarray, lower: bool = True) -> Words:
    """Cut a text column into words; ``lower`` folds A-Z first."""
    raw, bounds = text_bytes(column)
    data = _LOWER[raw] if lower else raw
    kind = kinds[data]
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[bounds] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    offsets = np.searchsorted(starts, bounds)
    return Words(data, starts, ends, offsets, _hash_runs(data, starts, ends))


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of symbol values times the powers of their places, from running sums over a chunk of the bytes."""
    out = np.empty(len(starts), np.uint64)
    chunk, first = 1 << 20, 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + chunk, "right")))
        stop = ends[last - 1]
        power, inverse = _powers(int(stop - base) + 1)
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_SYMBOLS[data[base:stop]] * power[:-1], out=total[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        first = last
    return out


def runs(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` consecutive words inside a row, and the index of their first words."""
    if length == 1:
        return found.hashes, np.arange(len(found))
    n = len(found) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = found.hashes[:n].copy()
    for k in range(1, length):
        total *= np.uint64(_BASE)
        total += found.hashes[k : n + k]
    row_end = np.repeat(found.offsets[1:], found.counts)[:n]
    first = np.flatnonzero(np.arange(n) + length <= row_end)
    return mix(total[first]), first
