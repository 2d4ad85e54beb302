"""Alignment of two tokenizations of the same texts.

A text's tokens are known by the byte offsets where they end. Where tokens of both vocabularies end together, the text is cut into
groups. The ends of a batch form two rising arrays; the walk over them keeps an index shift between the arrays. While tokens pair one
to one, the shift holds, and exponential probing compares doubling stretches of both arrays and jumps over them; where they
differ, the irregular group is resolved token by token and the shift becomes what it leads to.

How often each pair of ids ends together is counted over all texts. The most frequent pairs, of a bounded number, are broadcast to rate each
text's pairs; the pairs beyond them are rare, so that their shuffled join has no hot key.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.store import keep
from .byte_pairs import ordinary, read_json
from .words import slices

#: Pairs whose counts are broadcast, 17 bytes each.
FREQUENT = 1 << 20
#: How a pair's two ids make one number.
_SIDE = 32


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens that end together; ``a`` and ``b`` are rising ends, and their last ones are equal."""
    width = 8
    one, two = a.astype("<i8").tobytes(), b.astype("<i8").tobytes()
    left, right = a.tolist(), b.tolist()
    n, m = len(left), len(right)
    starts, others, lengths = [], [], []
    i = j = 0
    while i < n:
        x, y = left[i], right[j]
        while x != y:  # an irregular group: whichever side is behind takes a token
            if x < y:
                i += 1
                x = left[i]
            else:
                j += 1
                y = right[j]
        same, most = 1, min(n - i, m - j)
        while same < most:  # doubling stretches at the present shift
            reach = min(2 * same, most)
            if one[width * (i + same) : width * (i + reach)] != two[width * (j + same) : width * (j + reach)]:
                break
            same = reach
        if same < most:
            reach = min(2 * same, most)
            while reach - same > 1:  # the first difference lies in between
                middle = (same + reach) // 2
                if one[width * (i + same) : width * (i + middle)] == two[width * (j + same) : width * (j + middle)]:
                    same = middle
                else:
                    reach = middle
        starts.append(i)
        others.append(j)
        lengths.append(same)
        i, j = i + same, j + same
    lengths = np.array(lengths, np.int64)
    before = np.cumsum(lengths) - lengths
    steps = np.arange(int(lengths.sum()))
    return steps + np.repeat(np.array(starts, np.int64) - before, lengths), steps + np.repeat(np.array(others, np.int64) - before, lengths)


class _Side:
    """One vocabulary: how it encodes, the bytes of its ids, and their decimal names with the marks that may follow."""

    def __init__(self, encode, tokens: list[bytes], mark: bytes):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.names = np.array([b"%d%b" % (i, m) for m in (b",", mark) for i in range(len(tokens))], object)


@functools.lru_cache(maxsize=1)
def _sides(json_file: bytes, piece_file: bytes) -> tuple[_Side, _Side]:
    import sentencepiece

    encoder, tokens = read_json(json_file)
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    named = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return (
        _Side(lambda texts: [ordinary(encoder, " " + t) for t in texts], tokens, b"|"),
        _Side(lambda texts: library.encode(texts, num_threads=1), named, b";"),
    )


def _ids(side: _Side, texts: list[str]) -> list[list[int]]:
    """The ids of each text; of one whose tokens' bytes aren't those of a space and the text, none."""
    token = side.tokens.__getitem__
    return [x if b"".join(map(token, x)) == b" " + t.encode() else [] for t, x in zip(texts, side.encode(texts))]


def _aligned(one: _Side, two: _Side, texts: list[str | None]):
    """Per text: numbers of tokens and groups, digest of the groups; all links as rows and pairs."""
    wanted = [t or "" for t in texts]
    filled = [k for k, t in enumerate(wanted) if t]
    lists = [[[] for _ in wanted], [[] for _ in wanted]]
    for side, out in zip((one, two), lists):
        for k, ids in zip(filled, _ids(side, [wanted[k] for k in filled])):
            out[k] = ids
    for a, b in zip(*lists):
        if not a or not b:  # one side without tokens leaves the other without too
            a.clear(), b.clear()
    counts = [np.array([len(x) for x in ids], np.int64) for ids in lists]
    flat = [np.array([i for x in ids for i in x], np.int64) for ids in lists]
    # Both sides of a text have the same bytes, so that ends over the whole batch rise together.
    links = common_ends(np.cumsum(one.sizes[flat[0]]), np.cumsum(two.sizes[flat[1]]))
    stops = [np.cumsum(c) for c in counts]
    row = np.searchsorted(stops[0], links[0], "right")
    # A group's tokens of the first side come before those of the second; each token's name ends in its mark.
    order, names = [], []
    for k, (side, ids, at) in enumerate(zip((one, two), flat, links)):
        closing = np.zeros(len(ids), np.int64)
        closing[at] = len(side.tokens)
        ends = np.concatenate([np.zeros(1, np.int64), links[1 - k] + 1])  # tokens of the other side up to each group
        before = np.searchsorted(at, np.arange(len(ids)))  # groups that end before the token
        order.append(np.arange(len(ids)) + ends[before + k])
        names.append(side.names[ids + closing])
    text = np.empty(len(flat[0]) + len(flat[1]), object)
    for at, name in zip(order, names):
        text[at] = name
    bounds = [0, *(stops[0] + stops[1]).tolist()]
    digests = [hashlib.sha256(b"".join(text[a:b].tolist())[:-1]).hexdigest() if b > a else "" for a, b in zip(bounds, bounds[1:])]
    pairs = flat[0][links[0]] << _SIDE | flat[1][links[1]]
    return counts[0], counts[1], np.bincount(row, minlength=len(texts)), digests, row, pairs


def _paired(held):
    def paired(batches):
        one, two = _sides(*held.value)
        for batch in slices(batches, "text"):
            n_a, n_b, groups, digests, row, pairs = _aligned(one, two, batch.column("text").to_pylist())
            order = np.lexsort((pairs, row))
            row, pairs = row[order], pairs[order]
            new = np.ones(len(pairs), bool)
            new[1:] = (row[1:] != row[:-1]) | (pairs[1:] != pairs[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(pairs))).astype(np.int32)
            cut = pa.array(np.searchsorted(row[first], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(cut, pa.array(pairs[first])), pa.ListArray.from_arrays(cut, pa.array(times)),
                ],
                ["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
            )

    return paired


def _rated(known):
    """Rows with the sums over their frequent pairs; the others are left in ``pairs`` and ``times``."""

    def rated(batches):
        keys, counts, best = (np.frombuffer(x, t) for x, t in zip(known.value, ("<i8", "<i8", np.bool_)))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = [batch.column(c) for c in ("pairs", "times")]
                pairs, times = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
                sizes = np.diff(lists[0].offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), sizes)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                hit, chosen = row[found], at[found]
                np.add.at(sums[0], hit, times[found] * best[chosen])
                np.add.at(sums[1], hit, times[found] * counts[chosen])
                cut = pa.array(np.append(0, np.cumsum(np.bincount(row[~found], minlength=batch.num_rows))), pa.int32())
                rest = [pa.ListArray.from_arrays(cut, pa.array(x[~found])) for x in (pairs, times)]
                columns = [batch.column(c) for c in ("row", "id", "n_a", "n_b", "n_groups", "groups_sha256")]
                yield pa.RecordBatch.from_arrays([*columns, *rest, *map(pa.array, sums)], ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times", "n_best", "count_sum"])

    return rated


def _most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """Pairs down to a count that at most ``most`` of them reach."""
    levels = counted.groupBy(F.least("count", F.lit(10_000)).alias("count")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    least, total = 1 << 62, 0
    for level in sorted(levels, reverse=True):
        total += level["pairs"]
        if total > most:
            break
        least = level["count"]
    return counted.where(F.col("count") >= least)


def align(
    docs: DataFrame, json_file: bytes, piece_file: bytes, *, id: str = "doc_id", text: str = "text", frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    The first side is the byte-level vocabulary of ``json_file``, which encodes a space and the text; the second the vocabulary of
    ``piece_file``, which puts that space itself. Neither adds special tokens, and their strings are plain text. A link is a token of
    each that end at the same byte; its count is how often its two ids are linked in all of ``docs``, ``count_sum`` adds these up,
    and ``n_best`` counts the links of which no other has a higher count with the same id of the second side. The digest is of
    the groups' ids, ``a1,a2|b1;a3|b2,b3``. A text that is null, empty or not reproduced by the bytes of both sides has zeros and an empty digest.
    Repeated rows count as often as they occur. Other columns are not read. An empty table gives an empty one.
    """
    context = docs.sparkSession.sparkContext
    named = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = dict(named.dtypes)["id"]
    fixed = f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = named.mapInArrow(_paired(context.broadcast((json_file, piece_file))), fixed)
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counted = keep(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")))
    second = F.col("pair").bitwiseAND((1 << _SIDE) - 1)
    highest = counted.groupBy(second.alias("b")).agg(F.max("count").alias("highest"))  # a row per id of the second side
    counted = keep(counted.withColumn("b", second).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))
    top = _most_frequent(counted, frequent)
    found = top.toPandas().sort_values("pair")
    known = context.broadcast(tuple(np.ascontiguousarray(found[c].to_numpy(t)).tobytes() for c, t in (("pair", "<i8"), ("count", "<i8"), ("best", np.bool_))))
    rated = rows.mapInArrow(_rated(known), f"row long, {fixed}, n_best long, count_sum long")
    if counted.count() > len(found):
        rated = keep(rated)
        rest = rated.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
        sums = rest.join(counted, "pair").groupBy("row").agg(
            F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_count")
        )
        rated = rated.join(sums, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_count", F.lit(0))})
    return rated.select(F.col("id").alias(id), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
