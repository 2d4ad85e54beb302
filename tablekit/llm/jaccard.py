"""Exact Jaccard join of documents on word shingles, with signature trees.

Documents with equal sets are one class. Two classes that are similar enough share a shingle among their first ones in any
common order, and their sizes are close; so classes meet in buckets of shingle and size range. The order puts the most
frequent shingles last. Candidates are verified on the whole sets. That happens twice:

* Of each bucket only its first class, the hub, is a partner first, where many buckets agree. What that links is one component, so
  that a large group of near copies costs a star, not all its pairs.
* Buckets with the same hub are one group. Groups whose classes aren't in one component become signature trees: a node holds the
  OR of its classes' token bitmaps and their range of sizes, and a dual traversal drops pairs of nodes whose largest possible
  overlap is too small. First each pair of blocks gives a forest of its likeliest pairs, fewer than it has classes: were bitmaps exact,
  that forest would hold a link wherever there is one. Then the groups whose classes still aren't in one component give all pairs
  that are left between components, so that nothing depends on the bitmaps.

Only links matter to the result, which is a component for each document; no document, shingle or pair is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.joins import bounded, lookup_join
from ..plans.store import keep
from .graph import components, extended
from .words import BLANK_SEPARATED, mix, runs, slices, words

#: Frequent shingles that are put last, at most; they are broadcast.
FREQUENT = 200_000
#: Classes of a group in one block.
BLOCK = 1024
#: Of the shingles that a class has in buckets, the share that must agree on a partner in the first part.
AGREEING = 0.3


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, in that order. A text with fewer words has them all as one shingle."""
    found = words(column, BLANK_SEPARATED)
    hashes, first = runs(found, size)
    row_of = found.rows()
    rows = row_of[first]
    for length in range(1, size):
        short = np.flatnonzero(found.counts == length)
        if len(short):
            h, at = runs(found, length)
            chosen = np.isin(row_of[at], short)
            hashes, rows = np.concatenate([hashes, h[chosen]]), np.concatenate([rows, row_of[at[chosen]]])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], hashes[new]


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """Of ``n`` shingles, how many come first such that similar sets share one of them."""
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


def _counted(size: int, threshold: float):
    """Shingles early in the order that a task has seen in two documents or more, with their counts."""

    def counted(batches):
        seen = []
        for batch in slices(batches, "text"):
            rows, hashes = _sets(batch.column("text"), size)
            seen.append(hashes[hashes < np.uint64(min(1.0, 1.25 * (1 - threshold)) * (2**64 - 2049))])
        values, counts = np.unique(np.concatenate([*seen, np.zeros(0, np.uint64)]), return_counts=True)
        often = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["token", "seen"])

    return counted


def _frequent(docs: DataFrame, size: int, threshold: float, most: int) -> np.ndarray:
    """The most frequent shingles, sorted. They only settle the order, so that counts below two in a task may be missing."""
    counts = keep(docs.mapInArrow(_counted(size, threshold), "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen")).where("seen > 2"))
    levels = counts.groupBy(F.least("seen", F.lit(1_000_000)).alias("seen")).count().orderBy(F.desc("seen")).limit(10_000).collect()
    least, total = None, 0
    for level in levels:
        total += level["count"]
        if total > most:
            break
        least = level["seen"]
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(counts.where(F.col("seen") >= least).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def _described(size: int, threshold: float, frequent):
    """Per document: the set's size and digest, its first shingles, and its token bitmap."""

    def described(batches):
        late = frequent.value
        for batch in slices(batches, "text"):
            rows, hashes = _sets(batch.column("text"), size)
            if len(late):
                at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
                order = np.lexsort((hashes, late[at] == hashes, rows))
                rows, hashes = rows[order], hashes[order]
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            n = np.diff(cut)
            first = [hashes[a : a + p].view(np.int64) for a, p in zip(cut, np.where(n > 0, _prefix(n, threshold), 0))]
            names, bitmaps = [], []
            one, two = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), mix(hashes + np.uint64(0x14057B7EF767814F))
            for a, b in zip(cut, cut[1:]):
                names.append(f"{int(one[a:b].sum()):016x}{int(two[a:b].sum()):016x}" if b > a else None)
                bitmaps.append(_bitmap(hashes[a:b]).tobytes() if b > a else None)
            node = [None if x is None else int(x[:16], 16) - (1 << 63) for x in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(node, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary())],
                ["id", "key", "n", "name", "node", "first", "bitmap"],
            )

    return described


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """Four bits a shingle, up to the next power of two and 64 at least."""
    bits = max(64, 4 << (len(hashes) - 1).bit_length())
    at = (hashes >> np.uint64(20)) & np.uint64(bits - 1)
    out = np.zeros(bits, np.uint8)
    out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


class _Tree:
    """A signature tree over the classes of a block. Level 0 holds the classes, each higher one half as many nodes."""

    def __init__(self, size: np.ndarray, bitmaps: list[np.ndarray], root: np.ndarray):
        width = min(map(len, bitmaps))
        folded = np.stack([np.bitwise_or.reduce(b.reshape(-1, width)) for b in bitmaps])
        # What a class's size exceeds its bits by may overlap without showing in the bitmaps.
        hidden = size - np.bitwise_count(folded).sum(axis=1)
        self.levels = [(folded, size, size, hidden, root)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, hidden, root = self.levels[-1]
            if len(bits) % 2:
                bits, low, high, hidden, root = (np.concatenate([x, x[-1:]]) for x in (bits, low, high, hidden, root))
            a, b = slice(0, None, 2), slice(1, None, 2)
            same = np.where(root[a] == root[b], root[a], 0)  # 0: of several components
            self.levels.append((bits[a] | bits[b], np.minimum(low[a], low[b]), np.maximum(high[a], high[b]), np.maximum(hidden[a], hidden[b]), same))

    def fold(self, width: int) -> None:
        self.levels = [(np.bitwise_or.reduce(x[0].reshape(len(x[0]), -1, width), axis=1), *x[1:]) for x in self.levels]


def traverse(one: _Tree, two: _Tree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the classes of both trees whose pairs can't be ruled out. The same tree twice gives every pair once."""
    width = min(one.levels[0][0].shape[1], two.levels[0][0].shape[1])
    if one.levels[0][0].shape[1] > width:
        one = _refold(one, width)
    if two is not one and two.levels[0][0].shape[1] > width:
        two = _refold(two, width)
    top = max(len(one.levels), len(two.levels)) - 1
    u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        left, right = one.levels[min(level, len(one.levels) - 1)], two.levels[min(level, len(two.levels) - 1)]
        kept = [_possible(left, right, a, b, threshold, level) for a, b in zip(np.array_split(u, len(u) // 65536 + 1), np.array_split(v, len(v) // 65536 + 1))]
        ok = np.concatenate(kept)
        u, v = u[ok], v[ok]
        if level == 0:
            break
        u, v = _children(u, v, one.levels, two.levels, level)
        if one is two:
            ordered = u <= v if level > 1 else u < v
            u, v = u[ordered], v[ordered]
    return u, v


def _refold(tree: _Tree, width: int) -> _Tree:
    out = _Tree.__new__(_Tree)
    out.levels = tree.levels
    out.fold(width)
    # Folding loses bits: what a class's size exceeds its bits by grows.
    bits, low, high, _, root = out.levels[0]
    hidden = [low - np.bitwise_count(bits).sum(axis=1)]
    for above in out.levels[1:]:
        last = hidden[-1] if len(hidden[-1]) % 2 == 0 else np.concatenate([hidden[-1], hidden[-1][-1:]])
        hidden.append(np.maximum(last[::2], last[1::2])[: len(above[0])])
    out.levels = [(*x[:3], h, x[4]) for x, h in zip(out.levels, hidden)]
    return out


def _children(u, v, one, two, level):
    def below(x, levels):
        if level >= len(levels):
            return x, x, np.zeros(len(x), bool)
        a, b = 2 * x, 2 * x + 1
        return a, b, b < len(levels[level - 1][0])

    a1, a2, more_a = below(u, one)
    b1, b2, more_b = below(v, two)
    parts = [(a1, b1, np.ones(len(u), bool)), (a2, b1, more_a), (a1, b2, more_b), (a2, b2, more_a & more_b)]
    return np.concatenate([x[m] for x, _, m in parts]), np.concatenate([y[m] for _, y, m in parts])


def _possible(left, right, u, v, threshold, level):
    """Whether a pair of nodes may hold a link between different components."""
    bits, low, high, hidden, root = left
    bits2, low2, high2, hidden2, root2 = right
    apart = (root[u] != root2[v]) | (root[u] == 0)
    near = (high[u] >= threshold * low2[v] - 1e-9) & (high2[v] >= threshold * low[u] - 1e-9)
    ok = apart & near
    at = np.flatnonzero(ok)
    shared = np.bitwise_count(bits[u[at]] & bits2[v[at]]).sum(axis=1) + np.minimum(hidden[u[at]], hidden2[v[at]])
    ok[at] = shared >= threshold / (1 + threshold) * (low[u[at]] + low2[v[at]]) - 1e-6
    return ok


def likeness(one: _Tree, two: _Tree, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The largest similarity that the bitmaps of two classes allow."""
    width = min(one.levels[0][0].shape[1], two.levels[0][0].shape[1])
    left, right = ((t if t.levels[0][0].shape[1] == width else _refold(t, width)).levels[0] for t in (one, two))
    out = np.empty(len(u))
    for at in range(0, len(u), 65536):
        a, b = u[at : at + 65536], v[at : at + 65536]
        shared = np.bitwise_count(left[0][a] & right[0][b]).sum(axis=1) + np.minimum(left[3][a], right[3][b])
        out[at : at + 65536] = shared / np.maximum(left[1][a] + right[1][b] - shared, 1)
    return out


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges ``a``, ``b`` of a spanning forest of greatest weight: every tree takes its heaviest edge, round by round."""
    order = np.argsort(-weight, kind="stable")
    _, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    a, b = ends[: len(order)], ends[len(order) :]
    tree, edge, chosen = np.arange(ends.max(initial=-1) + 1), np.arange(len(order)), []
    while len(edge):
        first = np.full(len(tree), len(order))
        np.minimum.at(first, tree[a[edge]], edge)
        np.minimum.at(first, tree[b[edge]], edge)
        taken = np.unique(first[first < len(order)])
        chosen.append(taken)
        parent = np.arange(len(tree))
        for x, y in zip(tree[a[taken]].tolist(), tree[b[taken]].tolist()):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            parent[max(x, y)] = min(x, y)
        while (up := parent[parent]).tolist() != parent.tolist():
            parent = up
        tree = parent[tree]
        edge = edge[tree[a[edge]] != tree[b[edge]]]
    return order[np.sort(np.concatenate(chosen))] if chosen else np.zeros(0, np.int64)


def _candidates(threshold: float, sparse: bool = False):
    """Sorted rows of blocks to pairs of classes; ``sparse``: only a forest of each pair of blocks. Its rows may come in several batches."""

    def pairs(rows: dict[str, np.ndarray], bitmaps: list):
        order = np.lexsort((rows["n"], rows["root"]))
        alike = rows["i"][0] == rows["j"][0]

        def tree(chosen):
            return _Tree(rows["n"][chosen], [np.frombuffer(bitmaps[k], np.uint64) for k in chosen], rows["root"][chosen])

        one = order if alike else order[rows["block"][order] == rows["i"][0]]
        two = one if alike else order[rows["block"][order] == rows["j"][0]]
        if not len(one) or not len(two):
            return None
        left = tree(one)
        right = left if alike else tree(two)
        u, v = traverse(left, right, threshold)
        if sparse and len(u):
            best = forest(rows["root"][one[u]], rows["root"][two[v]], likeness(left, right, u, v))
            u, v = u[best], v[best]
        a, b = rows["node"][one[u]], rows["node"][two[v]]
        return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]

    names = ["hub", "i", "j", "block", "node", "root", "n"]

    def candidates(batches):
        held = None
        for batch in _with_end(batches):
            table = held
            if batch is not None:
                table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            rows = {n: table.column(n).to_numpy() for n in names}
            edge = np.flatnonzero((np.diff(rows["hub"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
            stops = [0, *edge.tolist(), table.num_rows]
            last = len(stops) - 1 if batch is None else len(stops) - 2  # the last group may go on in the next batch
            bitmaps = table.column("bitmap").slice(0, stops[last]).to_pylist()
            out = [x for a, b in zip(stops[:last], stops[1 : last + 1]) if b - a > 1 and (x := pairs({n: c[a:b] for n, c in rows.items()}, bitmaps[a:b]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["x", "y"])
            held = table.slice(stops[last]).combine_chunks()

    return candidates


def _with_end(batches):
    yield from batches
    yield None


def _similar(size: int, threshold: float):
    """Pairs of texts to the names of those whose sets are similar enough."""

    def similar(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sets = []
                for side in ("x_text", "y_text"):
                    rows, hashes = _sets(batch.column(side), size)
                    cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                    sets.append([hashes[a:b] for a, b in zip(cut, cut[1:])])
                ok = []
                for a, b in zip(*sets):
                    shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                    ok.append(shared >= threshold * (len(a) + len(b) - shared) - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column("x_name"), batch.column("y_name")], ["a", "b"]).filter(pa.array(ok))

    return similar


class _Join:
    """The parts of one join that share its tables."""

    def __init__(self, docs: DataFrame, size: int, threshold: float, block: int, frequent: int):
        self.size, self.threshold, self.block, self.docs = size, threshold, block, docs
        late = docs.sparkSession.sparkContext.broadcast(_frequent(docs.select("text"), size, threshold, frequent))
        schema = f"id {dict(docs.dtypes)['id']}, key long, n long, name string, node long, first array<long>, bitmap binary"
        self.sets = keep(docs.mapInArrow(_described(size, threshold, late), schema))
        filled = self.sets.where("n > 0")
        self.classes = keep(filled.groupBy("name", "node").agg(F.min("id").alias("least"), F.min(F.struct("id", "key")).alias("shown"), F.count("*").alias("copies")))

    def members(self) -> DataFrame:
        """``hub`` and ``node`` with its ``n`` and the number of buckets in which it meets the hub, the smallest node there."""
        one = self.sets.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min_by("first", "key").alias("first"))
        rows = keep(one).select("node", "n", F.explode("first").alias("token"))
        shared = rows.groupBy("token").count().where("count > 1").select("token")
        level = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(self.threshold)) + 1e-9) if self.threshold < 1 else F.col("n")
        ranged = rows.join(shared, "token").withColumn("level", F.explode(F.array(level, level + 1)))
        keyed = keep(ranged.select(F.xxhash64("token", "level").alias("bucket"), "node", "n"))
        full = keyed.groupBy("bucket").agg(F.count("*").alias("many"), F.min("node").alias("hub")).where("many > 1")
        return keep(keyed.join(full, "bucket").groupBy("hub", "node", "n").count())

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Names ``a`` and ``b`` of the pairs ``x``, ``y`` of nodes whose sets are similar."""
        pairs = keep(pairs)
        needed = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        chosen = self.classes.join(needed, "node").select("name", "node", "shown")
        shown = (F.col("id").eqNullSafe(F.col("shown.id"))) & (F.col("key") == F.col("shown.key"))
        texts = self.docs.join(chosen, shown).groupBy("name", "node").agg(F.min("text").alias("text"))
        texts = keep(texts)
        side = lambda c: texts.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name"), F.col("text").alias(f"{c}_text"))
        both = pairs.join(side("x"), "x").join(side("y"), "y").select("x_name", "x_text", "y_name", "y_text")
        return keep(both.mapInArrow(_similar(self.size, self.threshold), "a string, b string"))

    def stars(self, members: DataFrame) -> DataFrame:
        """Each class with the partner on which most of its buckets agree."""
        first = F.col("n") - F.ceil(F.col("n") * self.threshold - 1e-9) + 1
        agreed = members.where("node <> hub").where(F.col("count") >= AGREEING * first)
        return agreed.select(F.col("hub").alias("x"), F.col("node").alias("y"))

    def rest(self, members: DataFrame, roots: DataFrame, sparse: bool) -> DataFrame:
        """Candidates from the groups that hold several components."""
        named = self.classes.select("name", "node").join(roots, F.col("name") == roots["node_name"], "inner")
        labelled = members.join(named.groupBy("node").agg(F.min(F.xxhash64("root")).alias("root")), "node", "left")
        labelled = keep(labelled.select("hub", "node", "n", F.coalesce("root", F.xxhash64("node")).alias("root")))
        groups = labelled.groupBy("hub").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high"))
        mixed = keep(groups.where("low <> high").select("hub", "many", F.ceil(F.col("many") / self.block).cast("int").alias("blocks")))
        few = bounded(mixed)
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
        held = lookup_join(labelled, mixed, ["hub"], "many") if few is mixed else labelled.join(few, "hub")
        blocked = held.select("*", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        blocked = blocked.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "n")
        bitmaps = self.sets.where("n > 0").groupBy("node").agg(F.min_by("bitmap", "key").alias("bitmap"))
        ready = blocked.join(bitmaps, "node").select("hub", "i", "j", "block", "node", "root", "n", "bitmap")
        ready = ready.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
        return ready.mapInArrow(_candidates(self.threshold, sparse), "x long, y long").distinct()


def similarity_join(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, block: int = BLOCK, frequent: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``key``, the 64-bit hash of the text, and
    ``group``, a name that the documents of one component and no others have.

    Words are what blanks separate, with A-Z folded; a set holds the distinct runs of ``size`` words, or all words of a
    shorter text as one. Two documents link when their sets' Jaccard similarity is ``threshold`` or more, and ``component_id`` is the
    smallest id reachable by links. Null, empty and blank texts have no shingles and link with nothing. Repeated rows link
    with each other; rows without id count as partners but not as a smallest id, and have none if no partner has one. Other
    columns are not read; an empty table gives an empty one.
    """
    named = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    join = _Join(named, size, threshold, block, frequent)
    members = join.members()
    roots = components(join.verified(join.stars(members)))
    for sparse in (True, False):
        roots = extended(roots, join.verified(join.rest(members, roots.withColumnRenamed("node", "node_name"), sparse)))
    # Only classes with links or copies differ from documents that stand alone.
    notable = join.classes.drop("node").join(roots, F.col("name") == F.col("node"), "left").where("copies > 1 or root is not null")
    notable = keep(notable.select("name", "least", F.coalesce("root", "name").alias("root")))
    smallest = notable.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = notable.join(smallest, "root").select("name", "component_id", "root")
    spread = join.sets.select("id", "key", "n", F.coalesce("name", F.xxhash64("id").cast("string")).alias("name"))
    return spread.join(answers, "name", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "key", F.coalesce("root", "name").alias("group")
    )
