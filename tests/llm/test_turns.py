import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pyarrow.parquet as pq
import pytest

from tablekit.llm import turns
from tablekit.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
NOTHING = hashlib.sha256(b"").hexdigest()
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else x
        role, text = blank(role), blank(text)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Suffixes by words: every least (cost, audit, turns) from a row and the roles so far, compared as whole strings."""
    ok = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    memo = {}

    def best(i, last, inserted):
        if (i, last, inserted) in memo:
            return memo[i, last, inserted]
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            (role, text), fault = rows[i], found[i]
            cost, audit, held = best(i + 1, last, 0)
            options.append((cost + 2, "D" + audit, held))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for letter, new, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (last, new[:1]) in ok:
                        cost, audit, held = best(i + 1, ok[last, new[:1]], 0)
                        options.append((cost + price + more, letter + audit, (f"{new}:{text}", *held)))
        if inserted < 2:
            for new in ("user", "assistant"):
                if (last, new[0]) in ok:
                    cost, audit, held = best(i, new[0], inserted + 1)
                    options.append((cost + 5, "I" + audit, (f"{new}:", *held)))
        memo[i, last, inserted] = min(options, default=(10**9, "", ()))
        return memo[i, last, inserted]

    for i in range(len(rows), -1, -1):
        for last, inserted in product(("", "s", "u", "a"), (2, 1, 0)):
            best(i, last, inserted)
    return best(0, "", 0)


def brute(damaged, ids):
    by = defaultdict(list)
    for conv, turn, role, text in damaged:
        by[conv].append((turn, role, text))
    out = {}
    for conv in ids:
        rows = sorted(by.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        numbers = [t for t, _, _ in rows if t is not None]
        rows = [r[1:] for r in rows]
        found = faults(rows)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, held = cheapest(rows, found)
        assert LEGAL.fullmatch("".join(x[0] for x in held))
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(held).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def answers(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{DATA}/conversations.parquet").to_pylist()]
    assert answers(QUERIES["op12_conversations"](spark, DATA)) == brute(plain_damage(rows), {r[0] for r in rows})


def random_rows(draw, convs, most):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux"]
    texts = ["Yes.", "No!", "open", "", " \n", None, "é?", "why? ", "long " * 30 + ".", "　", ". x"]
    return [(c, draw.choice([None, *range(8)]), draw.choice(roles), draw.choice(texts)) for c in convs for _ in range(draw.randint(0, most))]


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = random_rows(random.Random(6), [None, *range(60)], 9)
    rows += rows[:50]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, id int, c string")
    got = answers(turns.Repair(df).report())
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == brute(plain, {r[0] for r in rows})


def test_one_conversation_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 7)
    draw = random.Random(7)
    rows = [(1, k, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["Yes.", "open", "", f"{k}.", f"{k}"])) for k in range(400)]
    rows += [(1, 400, "user", "same.")] * 100 + [(2, 0, "user", "Yes."), (2, 1, "assistant", "No.")]
    fixed = turns.Repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5))
    assert fixed.segments.where("c = '=1'").count() > 3
    assert answers(fixed.report()) == brute(rows, {1, 2})


def test_parts_join_to_the_whole():
    draw = random.Random(8)
    for _ in range(300):
        codes = [draw.randrange(16) for _ in range(draw.randint(0, 14))]
        whole = turns.paths(codes, 0, True)
        assert turns.segment(codes, (0,), True, block=draw.randint(1, 5))[0] == whole
        state = turns._least(whole)
        assert turns._left_in(0, codes, whole[state][1]) == state


def test_dropped_conversations_stay_in_the_result(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Yes.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert answers(QUERIES["op12_conversations"](spark, str(tmp_path))) == {gone: (0, 0, 0, 0, 0, 0, "", NOTHING)}


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.Repair(turns.damaged(rows)).report().collect() == []


@pytest.mark.parametrize("rows", [20_000])
def test_long_segments_take_blocks(rows):
    codes = [(1 if k % 2 else 2) * 4 for k in range(rows)]
    found = turns.segment(codes, (0,), True)[0]
    assert found[turns._least(found)][0] == 4
