"""Encoding and decoding with merge-type sentencepiece vocabularies.

An agenda of adjacent symbol pairs, ordered by the score of the piece that they form and then by their place, merges a text's
characters. No piece of such a vocabulary holds the blank sign after another character, so that what stands between blanks is
merged by itself, and a bounded memory of such parts saves merging the common ones again. The parts of a batch that the memory lacks are
merged together, each by its own agenda, one entry of every agenda at a time; long parts have a heap. What is new to a task's
memory is checked against the sentencepiece library, one call per Arrow batch. Memories end with their task.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices

BLANK = "▁"
#: Parts of texts that a task remembers, in each of two generations, and the characters of the longest one.
REMEMBERED, LONGEST = 1 << 18, 64


#: The agenda's entry of two symbols that form no piece.
_NEVER = 1 << 62


def _fields(data: bytes):
    """The fields of a serialized message: number and value."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Pieces(dict):
    """A vocabulary, and the memory of encoded parts: from a part to its ids as the bytes of 32-bit integers."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        message = dict(_fields(model))  # 2: how it was trained, 3: how texts are normalised
        trained, normal = dict(_fields(message[2])), dict(_fields(message[3]))
        ids = range(self.library.get_piece_size())
        kinds = {"control": self.library.is_control, "byte": self.library.is_byte, "unknown": self.library.is_unknown, "unused": self.library.is_unused}
        kind = {i: next((k for k, f in kinds.items() if f(i)), "normal") for i in ids}
        self.piece = {i: self.library.id_to_piece(i) for i in ids}
        self.ids = {p: i for i, p in self.piece.items() if kind[i] == "normal"}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(self.piece[i][3:5], 16): i for i in ids if kind[i] == "byte"}
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.prefix = bool(normal.get(3, 1))
        if (
            trained.get(3, 1) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trained.get(24, 0)
            or "unused" in kind.values() or any(self.scores[p] == 0 and len(p) > 1 for p in list(self.ids)[1:])
        ):
            raise ValueError("only merge-type vocabularies without normalisation, unused and user-defined pieces")
        self.characters = {p: i for p, i in self.ids.items() if len(p) == 1}
        if BLANK in self.characters:
            self.characters[" "] = self.characters[BLANK]
        self.cut = self._cut()
        text = {i: "" if kind[i] == "control" else trained.get(44, b" \xe2\x81\x87 ").decode() if kind[i] == "unknown" else self.piece[i].replace(BLANK, " ") for i in ids}
        self.bytes = [bytes([int(self.piece[i][3:5], 16)]) if kind[i] == "byte" else text[i].encode() for i in ids]
        self.is_byte = np.array([kind[i] == "byte" for i in ids])
        self.silent = np.array([kind[i] == "control" for i in ids])
        self.many = len(ids) + 1
        self.pairs = self._pairs()
        self.symbol = np.full(0x110000, len(ids), np.int64)
        for c, i in self.characters.items():
            self.symbol[ord(c)] = i
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_order, self.pair_becomes = (np.array([self.pairs[k][x] for k in self.pair_keys.tolist()], np.int64) for x in (0, 1))
        self.new: list[tuple[str, bytes]] = []
        self.older: dict[str, bytes] = {}

    def _pairs(self) -> dict[int, tuple[int, int]]:
        """Two adjacent symbols as one number: the priority of merging them, and the symbol that they become."""
        order = {x: k << 32 for k, x in enumerate(sorted({-s for s in self.scores.values()}))}
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.many + right] = order[-self.scores[piece]], i
        return pairs

    def merge(self, part: str) -> list[int]:
        """The ids of a part, whose blanks are plain. The agenda holds priorities and places: the best score first, then the leftmost pair."""
        alone, many, pairs = self.many - 1, self.many, self.pairs
        symbols = [self.characters.get(c, alone) for c in part]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [found[0] | i for i in range(n - 1) if (found := pairs.get(symbols[i] * many + symbols[i + 1]))]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            a = entry & 0xFFFFFFFF
            b = after[a]
            if symbols[a] < 0 or b == n:
                continue
            found = pairs.get(symbols[a] * many + symbols[b])
            if not found or found[0] | a != entry:
                continue  # one of the two has been merged since
            symbols[a], symbols[b], after[a] = found[1], -1, after[b]
            if after[b] < n:
                before[after[b]] = a
                if next_ := pairs.get(found[1] * many + symbols[after[b]]):
                    heapq.heappush(agenda, next_[0] | a)
            if (c := before[a]) >= 0 and (next_ := pairs.get(symbols[c] * many + found[1])):
                heapq.heappush(agenda, next_[0] | c)
        if alone not in symbols:
            return [s for s in symbols if s >= 0]
        out: list[int] = []
        for i, s in enumerate(symbols):
            if s == alone:
                out += [self.byte_ids[x] for x in part[i].encode()] if self.byte_ids else [self.unknown]
            elif s >= 0:
                out.append(s)
        return out

    def merge_many(self, parts: list[str]) -> list[bytes]:
        """The ids of many short parts, as bytes. In every round each part's agenda gives its first entry, until all are empty."""
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        symbol = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        alone = self.many - 1
        out: list[bytes] = [b""] * len(parts)
        part = np.repeat(np.arange(len(parts)), length)
        entry, becomes = self._agenda(symbol[:-1], symbol[1:], part[1:] == part[:-1])
        while len(symbol):
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            # An entry's place breaks ties; pieces' orders take the high bits.
            first = np.minimum.reduceat(entry | np.arange(len(entry)), starts)
            ended = first >= _NEVER
            if ended.any():
                sizes = np.diff(np.append(starts, len(symbol)))
                over = np.repeat(ended, sizes)
                whole, names = symbol[over].astype("<i4"), part[starts[ended]]
                cut = np.cumsum(np.append(0, sizes[ended])).tolist()
                data = whole.tobytes()
                odd = set((np.searchsorted(cut, np.flatnonzero(whole == alone), "right") - 1).tolist())
                for k, name in enumerate(names.tolist()):
                    out[name] = data[4 * cut[k] : 4 * cut[k + 1]] if k not in odd else np.array(self.merge(parts[name]), "<i4").tobytes()
                symbol, part, entry, becomes = symbol[~over], part[~over], entry[~over], becomes[~over]
                first = first[~ended] - np.cumsum(over)[starts[~ended]]
                if not len(symbol):
                    break
            at = first & 0xFFFFFFFF
            symbol[at] = becomes[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            symbol, part, entry, becomes = symbol[stay], part[stay], entry[stay], becomes[stay]
            at = moved[at]
            # The merged symbols have new neighbours on both sides.
            for place in (at, at[at > 0] - 1):
                near = np.minimum(place + 1, len(symbol) - 1)
                entry[place], becomes[place] = self._looked_up(symbol[place], symbol[near], (near > place) & (part[near] == part[place]))
        return out

    def _agenda(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry, becomes = self._looked_up(left, right, together)
        return np.append(entry, _NEVER), np.append(becomes, 0)

    def _looked_up(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of merging two symbols, or never, and what they become."""
        keys = left * self.many + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = together & (self.pair_keys[at] == keys)
        return np.where(found, self.pair_order[at], _NEVER), self.pair_becomes[at]

    def learn(self, parts: set[str]) -> None:
        """Put the parts into the memory."""
        wanted = [p for p in parts if p not in self]
        if len(self) + len(wanted) > REMEMBERED:
            self.older = {p: x for p, x in self.items() if len(p) <= LONGEST}
            self.clear()
            wanted = list(parts)
        self.update((p, x) for p in wanted if (x := self.older.get(p)) is not None)
        wanted = [p for p in wanted if p not in self.older]
        short = [p for p in wanted if len(p) <= LONGEST]
        new = [*zip(short, self.merge_many(short)), *((p, np.array(self.merge(p), "<i4").tobytes()) for p in wanted if len(p) > LONGEST)]
        self.update(new)
        self.new += new

    def __missing__(self, part: str) -> bytes:
        self.learn({part})
        return self[part]

    def forget(self) -> None:
        """Empty the memory, but not of what is still to be checked."""
        self.older = {}
        self.clear()

    def _cut(self) -> re.Pattern:
        """Where texts, with plain blanks, may be cut: between characters that no piece holds side by side."""
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(b == BLANK and a != BLANK for a, b in pairs):
            return re.compile(".+", re.DOTALL)
        letter = re.compile(r"[^\W\d_]")
        # Raised digits and the like count as letters here; those that stand before other characters don't.
        odd = {a for a, b in pairs if letter.match(a) and not letter.match(b) and not a.isalpha()}
        known = lambda c: bool(letter.match(c)) and c not in odd
        if any(known(a) and not known(b) for a, b in pairs):
            return re.compile(" *[^ ]+| +")
        odd = re.escape("".join(sorted(odd)))
        letters, others = rf"[^\W\d_{odd}]", rf"(?:[^\w ]|[\d_{odd}])"
        return re.compile(f" *{others}*{letters}+| *{others}+| +")

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(BLANK, " ")
        return self.cut.findall(" " + text if self.prefix else text)

    def encode(self, text: str | None, end: bool = True) -> np.ndarray:
        found = b"".join(map(self.__getitem__, self.parts(text or "")))
        return np.frombuffer(found + (np.array([self.end], "<i4").tobytes() if end else b""), "<i4")

    def check(self) -> None:
        """Compare the parts that are new since the last call with the library's answer, in one call to it."""
        new, self.new = self.new, []
        # The library puts a blank before a text; a part without one is checked behind a blank and a line break.
        lead = " " if self.prefix else ""
        given = [p if not lead or p[0] == " " else " \n" + p for p, _ in new]
        answers = self.library.encode([p[len(lead) :] for p in given], num_threads=1)
        skip = len(self.merge(" ")) + len(self.merge("\n"))
        for (part, found), whole, ids in zip(new, given, answers):
            if part != " " and found != np.array(ids if part == whole else ids[skip:], "<i4").tobytes():
                raise ValueError(f"the library encodes {part!r} as {ids}")

    def decode(self, ids: np.ndarray) -> str:
        spoken = np.flatnonzero(~self.silent[ids])
        if not len(spoken):
            return ""
        ids = ids[spoken[0] : spoken[-1] + 1]
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        try:
            if len(ids) > len(spoken):  # a control piece inside parts the bytes before it from those behind it
                raise ValueError
            text = data.decode()
        except ValueError:
            text = self._decode_broken(ids)
        return text[1:] if self.prefix and self.piece[int(ids[0])].startswith(BLANK) else text

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Each byte of a run of byte pieces that starts no whole character becomes one replacement character."""
        out = []
        for run in np.split(ids, np.flatnonzero(np.diff(self.is_byte[ids])) + 1):
            data = b"".join(map(self.bytes.__getitem__, run.tolist()))
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(data[: e.start].decode() + "�")
                    data = data[e.start + 1 :]
        return "".join(out)


@functools.lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """One vocabulary, with its memory, per worker."""
    return Pieces(model)


def encoded(batch: pa.RecordBatch, held: Pieces, end: bool, check: bool) -> list[np.ndarray]:
    parts = [held.parts(t or "") for t in batch.column("text").to_pylist()]
    held.learn(set(itertools.chain.from_iterable(parts)))
    tail = np.array([held.end], "<i4").tobytes() if end else b""
    ids = [np.frombuffer(b"".join(map(held.__getitem__, p)) + tail, "<i4") for p in parts]
    held.check() if check else held.new.clear()
    return ids


def _row(df: DataFrame, id: str, *columns):
    """The id under a name of its own, so that other columns of any name may stand beside it."""
    return df.select(F.col(id).alias("id"), *columns)


def encode(docs: DataFrame, model: bytes, *, id: str = "doc_id", text: str = "text", end: bool = True, check: bool = True, decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: id and ``ids``, the whole text's ids, with the end id last if ``end``. With ``decoded`` also
    ``text``, what the ids stand for, as ``decode`` gives it but from the same worker.

    ``model`` is the content of a vocabulary file. Null and empty texts have no ids of their own. Repeated rows give repeated
    rows. Other columns are not read. ``check`` compares with the library and raises where it differs.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = pieces(held.value)
        for batch in slices(batches, "text"):
            ids = encoded(batch, table, end, check)
            cut = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, "<i4")]).astype("<i4")
            columns = [batch.column("id"), pa.ListArray.from_arrays(cut, pa.array(flat))]
            if decoded:
                columns.append(pa.array([table.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "text"][: len(columns)])
        # Other work may follow in this worker.
        table.forget()
        pa.default_memory_pool().release_unused()

    named = _row(docs, id, F.col(text).cast("string").alias("text"))
    schema = f"id {dict(named.dtypes)['id']}, ids array<int>" + ", text string" * decoded
    return named.mapInArrow(run, schema).withColumnRenamed("id", id)


def decode(rows: DataFrame, model: bytes, *, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``rows`` reduced to id, ``ids`` and ``text``, the text that the ids stand for; null ids have an empty text."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = pieces(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column("ids")
                cut, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                text = [table.decode(flat[a:b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(text, pa.string())], ["id", "ids", "text"])

    named = _row(rows, id, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    return named.mapInArrow(run, f"id {dict(named.dtypes)['id']}, ids array<int>, text string").withColumnRenamed("id", id)
