"""Repair of conversation structure by cheapest edits.

Rows are put in order by range partitions, so that a conversation of any length is spread over tasks; what lies in one partition is a segment.
A row is reduced to a small code: the initial of its role and its first fault. The cheapest edits are a shortest path in a graph without
cycles, whose nodes are a row and the state of the roles so far. A path's length is one big integer: its high digits are the cost, and
below them each edit has one digit of fixed width, in order, with zeros behind the last; so the smallest integer is the least cost and,
among equal costs, the least audit.

Two paths to one node never have audits of which one begins with the other: both have edited the same rows, and one insertion in a
gap leads to another state. So what is best inside a part is best in the whole, and long conversations are put together from
parts, each solved from every state that it may be entered in.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.joins import bounded, lookup_join
from ..plans.order import PART, POS, sorted_parts
from ..plans.store import keep

WHITE = " \t\n\v\f\r"
#: Letters of the edits in the order of their digits, from 1 on: Delete, Insert, Keep, Rerole.
EDITS = "DIKR"
_DELETE, _INSERT, _KEEP, _REROLE = 1, 2, 3, 4
COST = {_DELETE: 2, _INSERT: 5, _KEEP: 0, _REROLE: 1}
#: What a row that stays though it breaks off costs more.
TRUNCATED = 5
#: Rows that are solved with one big integer.
BLOCK = 256
#: The states: nothing yet, a system turn, a user's turn last, an answer last. A missing step is not allowed.
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
_FINAL = (0, 3)
_INITIALS = "sua"
_ROLE = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, OPEN = 1, 2, 3


def _edits(state: int, code: int):
    """Edits of a row with ``code`` in ``state``: digit, cost and the next state."""
    initial, fault = code >> 2, code & 3
    yield _DELETE, COST[_DELETE], state
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == OPEN else 0
        if initial < 3 and (kept := _AFTER.get((state, _INITIALS[initial]))) is not None:
            yield _KEEP, COST[_KEEP] + more, kept
        yield _REROLE, COST[_REROLE] + more, _AFTER[state, _WANTED[state]]


_STEPS = [[tuple(_edits(state, code)) for code in range(16)] for state in range(4)]
_INSERTED = [_AFTER[state, _WANTED[state]] for state in range(4)]


def paths(codes, start: int, last: bool) -> dict[int, tuple[int, str]]:
    """For each state in which the rows can be left: the least cost and audit. Behind the last rows of a conversation one insertion may follow."""
    width = 2 * len(codes) + 1
    place = [5**k for k in range(width + 1)]  # place[width] is one unit of cost
    unit = place[width]
    best = {start: (0, width)}  # the integer, and the digits that are still free

    def gap(found):
        out = dict(found)
        for state, (value, free) in found.items():
            new = value + COST[_INSERT] * unit + _INSERT * place[free - 1]
            to = _INSERTED[state]
            if to not in out or new < out[to][0]:
                out[to] = (new, free - 1)
        return out

    for code in codes:
        found: dict[int, tuple[int, int]] = {}
        for state, (value, free) in gap(best).items():
            for digit, cost, to in _STEPS[state][code]:
                new = value + cost * unit + digit * place[free - 1]
                if to not in found or new < found[to][0]:
                    found[to] = (new, free - 1)
        best = found
    if last:
        best = gap(best)
    return {state: (value // unit, _letters(value % unit, free, width, place)) for state, (value, free) in best.items()}


def _letters(digits: int, free: int, width: int, place: list[int]) -> str:
    out = []
    for k in range(width - 1, free - 1, -1):
        digit, digits = divmod(digits, place[k])
        out.append(EDITS[digit - 1])
    return "".join(out)


def through(parts: list[list[dict[int, tuple[int, str]]]], start: int = 0) -> dict[int, tuple[int, tuple[str, ...]]]:
    """Parts put together: ``parts[k][state]`` are the ways through part ``k`` from a state. Gives cost and audits by the state at the end."""
    best: dict[int, tuple[int, tuple[str, ...]]] = {start: (0, ())}
    for part in parts:
        found: dict[int, tuple[int, tuple[str, ...]]] = {}
        for state, (cost, audits) in best.items():
            for to, (more, audit) in part[state].items():
                new = (cost + more, (*audits, audit))
                if to not in found or _less(new, found[to]):
                    found[to] = new
        best = found
    return best


def _less(one: tuple[int, tuple[str, ...]], two: tuple[int, tuple[str, ...]]) -> bool:
    """Audits of one part may begin with each other only if they lead to different states; then the next parts decide."""
    return (one[0], "".join(one[1])) < (two[0], "".join(two[1]))


def segment(codes, starts, last: bool, block: int = BLOCK) -> list[dict[int, tuple[int, str]]]:
    """The ways through a segment from each of the states ``starts``; other states have none."""
    cuts = [codes[k : k + block] for k in range(0, len(codes), block)] or [codes]
    out: list[dict[int, tuple[int, str]]] = [{}, {}, {}, {}]
    if len(cuts) == 1:
        for s in starts:
            out[s] = paths(codes, s, last)
        return out
    parts = [[paths(c, s, last and k == len(cuts) - 1) for s in range(4)] for k, c in enumerate(cuts)]
    for s in starts:
        out[s] = {to: (cost, "".join(audits)) for to, (cost, audits) in through(parts, s).items()}
    return out


def _least(found: dict[int, tuple]) -> int:
    return min((s for s in _FINAL if s in found), key=lambda s: (found[s][0], "".join(found[s][1])))


def _left_in(state: int, codes, audit: str) -> int:
    """The state after the edits of ``audit``."""
    for _, state, _ in _walk(state, codes, audit):
        pass
    return state


def _walk(state: int, codes, audit: str):
    """Per edit its letter, the state behind it, and the role that it gives or None."""
    at = 0
    for letter in audit:
        role = None
        if letter == "I":
            role, state = _ROLE[_WANTED[state]], _INSERTED[state]
        else:
            if letter == "R":
                role, state = _ROLE[_WANTED[state]], _AFTER[state, _WANTED[state]]
            elif letter == "K":
                state = _AFTER[state, _INITIALS[codes[at] >> 2]]
            at += 1
        yield letter, state, role


def _alone(batches):
    """Conversations in one segment."""
    for batch in batches:
        found = [segment(c, (0,), True)[0] for c in batch.column("codes").to_pylist()]
        ends = [f[_least(f)] for f in found]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("c"), batch.column("part"), pa.array([0] * n, pa.int32()), pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.string())],
            ["c", "part", "entry", "cost", "audit"],
        )


_WAY = "array<struct<entry:int, left:int, cost:long, audit:string>>"


def _ways(batches):
    """All ways through segments of longer conversations."""
    for batch in batches:
        rows = zip(batch.column("codes").to_pylist(), batch.column("last").to_pylist())
        ways = [[{"entry": s, "left": to, "cost": w[0], "audit": w[1]} for s, f in enumerate(segment(c, range(4), last)) for to, w in f.items()] for c, last in rows]
        kind = pa.list_(pa.struct([("entry", pa.int32()), ("left", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("part"), pa.array(ways, kind)], ["c", "part", "ways"])


def _chosen(batches):
    """Of the ways through each segment of a conversation, the one that its best edits take."""
    for batch in batches:
        for c, held in zip(batch.column("c").to_pylist(), batch.column("parts").to_pylist()):
            parts = []
            for p in held:
                by: list[dict[int, tuple[int, str]]] = [{}, {}, {}, {}]
                for w in p["ways"]:
                    by[w["entry"]][w["left"]] = (w["cost"], w["audit"])
                parts.append(by)
            found = through(parts)
            audits = found[_least(found)][1]
            state, rows = 0, []
            for p, by, audit in zip(held, parts, audits):
                to, cost = next((to, w[0]) for to, w in by[state].items() if w[1] == audit)
                rows.append((c, p["part"], state, cost, audit))
                state = to
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["c", "part", "entry", "cost", "audit"])


def _applied(batches):
    """Per row of a segment: its edit, its new role or null, and the roles inserted before it and behind it."""
    for batch in batches:
        out: list[tuple] = []
        for part, first, codes, entry, audit in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "codes", "entry", "audit"))):
            before, at = None, first
            for letter, _, role in _walk(entry, codes, audit):
                if letter != "I":
                    out.append((part, at, letter, role, before, None))
                    before, at = None, at + 1
                elif at < first + len(codes):
                    before = role
                else:
                    out[-1] = (*out[-1][:5], role)
        columns = list(zip(*out)) or [[]] * 6
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], [PART, POS, "edit", "given", "before", "behind"])


def _hashed(batches):
    """Sorted lines to a digest for each conversation, without holding one."""
    held, digest = None, None
    for batch in batches:
        done = []
        for c, line in zip(batch.column("c").to_pylist(), batch.column("line").to_pylist()):
            if c != held:
                if digest:
                    done.append((held, digest.hexdigest()))
                held, digest = c, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["c", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([digest.hexdigest()])], ["c", "repaired_sha256"])


class Repair:
    """The cheapest edits of every conversation in ``rows``.

    A conversation is the rows of one id (null is an id), in the order of ``turn``, nulls first; rows of one turn are ordered by role and text,
    and equal rows in any order. A null role or text counts as one blank. A row's first fault counts: blank (no other characters than ASCII white space), duplicate (its role
    and text came earlier), truncated (the last visible character is none of ``.!?``). The edits keep, rerole to user or assistant, delete
    (as blank rows and duplicates must be), or insert an empty turn, so that the initials of the roles read ``(s?(ua)+)?``.

    Texts of any length and conversations of any number of rows are taken whole; an audit, which has a letter for each edit, is one
    value. An empty table has no conversations. Other columns are not read.
    """

    def __init__(self, rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.id = id
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        base = keep(rows.select(
            F.coalesce(F.concat(F.lit("="), F.col(id).cast("string")), F.lit("")).alias("c"), F.col(id).alias("id"), F.col(turn).cast("long").alias("turn"),
            blank(role).alias("role"), blank(text).alias("text"), F.monotonically_increasing_id().alias("row"),
        ))
        hashed = base.withColumn("hash", F.xxhash64("text"))
        # The last key parts equal rows, however many there are.
        self.rows = sorted_parts(hashed, ["c", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), "hash", "row"])
        self.segments = keep(self._segments())
        self.solved = keep(self._solved())

    def _segments(self) -> DataFrame:
        end = F.rtrim("text", F.lit(WHITE))
        initial = F.substring("role", 1, 1)
        number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        slim = self.rows.select(
            "c", PART, POS, F.crc32(F.col("role").cast("binary")).alias("h0"), F.xxhash64("role").alias("h1"), "hash", F.crc32(F.col("text").cast("binary")).alias("h2"),
            number.alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"),
        )
        keys = ["c", "h0", "h1", "hash", "h2"]
        repeated = keep(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(PART, POS)).alias("first")).where("copies > 1"))
        small = bounded(repeated)
        joined = lookup_join(slim, repeated, keys, "copies", "left") if small is repeated else slim.join(small, keys, "left")
        again = F.col("first").isNotNull() & (F.struct(PART, POS) != F.col("first"))
        fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("open"), OPEN).otherwise(0)
        code = (F.col("initial") * 4 + fault).cast("tinyint").alias("code")
        codes = F.transform(F.array_sort(F.collect_list(F.struct(POS, code))), lambda x: x["code"])  # a partition's rows at most
        grouped = joined.groupBy("c", F.col(PART).alias("part")).agg(F.min(POS).alias("first"), codes.alias("codes"))
        found = lambda f: F.size(F.filter("codes", lambda x: x.bitwiseAND(3) == f)).cast("long")
        return grouped.withColumns({"blank": found(BLANK), "duplicate": found(DUPLICATE), "truncated": found(OPEN)})

    def _spread(self) -> DataFrame:
        """Conversations of several segments. No more than one crosses each border of partitions."""
        return F.broadcast(self.segments.groupBy("c").agg(F.max("part").alias("last"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"))

    def _solved(self) -> DataFrame:
        schema = "c string, part int, entry int, cost long, audit string"
        spread = self._spread()
        alone = self.segments.join(spread, "c", "left_anti").select("c", "part", "codes").mapInArrow(_alone, schema)
        longer = self.segments.join(spread, "c").select("c", "part", "codes", (F.col("part") == F.col("last")).alias("last"))
        ways = longer.mapInArrow(_ways, f"c string, part int, ways {_WAY}")
        together = ways.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "ways"))).alias("parts"))
        return alone.unionByName(together.mapInArrow(_chosen, schema))

    def repaired(self) -> DataFrame:
        """The input's rows in ``__part__``, ``__pos__`` order with ``edit`` (D, K or R), the new ``role``, and the roles inserted ``before`` and ``behind`` the row."""
        held = self.segments.select("c", "part", "first", "codes").join(self.solved.select("c", "part", "entry", "audit"), ["c", "part"])
        edits = held.mapInArrow(_applied, f"{PART} int, {POS} long, edit string, given string, before string, behind string")
        rows = self.rows.join(edits, [PART, POS])
        return rows.select("c", "id", PART, POS, "turn", F.coalesce("given", "role").alias("role"), "text", "edit", "before", "behind")

    def _digests(self) -> DataFrame:
        empty = lambda c: F.concat(c, F.lit(":"))
        own = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
        parts = F.array_compact(F.array(empty("before"), own, empty("behind")))
        lines = self.repaired().select("c", PART, POS, parts.alias("parts")).where(F.size("parts") > 0)
        lines = lines.select("c", PART, POS, F.array_join("parts", "\n").alias("line"))
        spread = self._spread()
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(POS, "line"))), lambda x: x["line"])  # a segment at most
        alone = lines.join(spread, "c", "left_anti").groupBy("c").agg(F.sha2(F.array_join(ordered, "\n").cast("binary"), 256).alias("repaired_sha256"))
        # A digest is one after another by nature; a longer conversation streams through a task without being held.
        longer = lines.join(spread, "c", "left_semi").repartition("c").sortWithinPartitions("c", PART, POS).select("c", "line")
        return alone.unionByName(longer.mapInArrow(_hashed, "c string, repaired_sha256 string"))

    def report(self) -> DataFrame:
        """One row per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``."""
        turns = self.rows.groupBy("c", "turn").agg(F.min("id").alias("id")).groupBy("c").agg(
            F.min("id").alias("id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
        )
        initial = lambda x: F.shiftright(x.cast("int"), 2)
        legal = lambda a, b: ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
        pairs = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1), lambda a, b: legal(initial(a), initial(b)))
        inside = F.size(F.filter(pairs, lambda x: ~x)).cast("long")
        # Borders of segments: at most as many for a conversation as there are partitions.
        edges = F.array_sort(F.collect_list(F.struct("part", initial(F.element_at("codes", 1)).alias("first"), initial(F.element_at("codes", -1)).alias("last"))))
        crossed = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: legal(a["last"], b["first"]))
        counts = self.segments.withColumn("inside", inside).groupBy("c").agg(
            *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "inside")], edges.alias("edges")
        ).withColumn("illegal", F.col("inside") + F.size(F.filter(crossed, lambda x: ~x)))
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
        edits = self.solved.groupBy("c").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
        joined = turns.join(counts, "c").join(edits, "c").join(self._digests(), "c", "left")
        return joined.select(
            F.col("id").alias(self.id), "gaps", "blank", "duplicate", "truncated", F.col("illegal").cast("long").alias("illegal"), "cost", "audit",
            F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )


def damaged(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, which depend on id and turn only: dropped, emptied, without closing marks, repeated, or with the role user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank(id), F.lit(":"), blank(turn)).cast("binary")), F.lit(20))
    named = rows.select(F.col(id).alias(id), F.col(turn).alias(turn), blank(role).alias(role), blank(text).alias(text), kind.alias("__kind__")).where("__kind__ <> 0")
    changed = F.when(F.col("__kind__") == 1, "").when(F.col("__kind__") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__kind__") == 3, 2).otherwise(1)))
    return named.select(id, turn, F.when(F.col("__kind__") == 4, "user").otherwise(F.col(role)).alias(role), changed.alias(text), copies.alias("__copy__")).drop("__copy__")
