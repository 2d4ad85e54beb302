"""Correlation matrices: Pearson, Spearman and Kendall (tau-b), pairwise on rows where both values are known."""

from __future__ import annotations

import decimal
import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidParameter
from ..plans.columns import INDEX, as_double, numeric_columns
from ..plans.joins import lookup_join, partitions_for
from ..plans.metrics import null_counts
from ..plans.order import running_sums
from ..plans.store import keep

METHODS = ("pearson", "spearman", "kendall")
PAIRS_PER_JOB = 100
PART_CELLS = 1 << 18  # cells in one range of Kendall's grid
TASK_ROWS = 1 << 20  # rows that one task sorts or groups at a time
ESTIMATED = 16  # one group in so many, by its hash, is counted to estimate how many there are
SLOTS = 8  # for each task, so that tasks get about as many rows


def get_correlation_matrix(
    df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None,
    min_correlation: float | None = None, index: str = INDEX,
) -> DataFrame:
    """(col1, col2, r) for all ordered pairs with the diagonal; an undefined correlation is 0.0.

    ``min_correlation`` keeps pairs with ``abs(r)`` at least that large, and the diagonal.
    """
    if method not in METHODS:
        raise InvalidParameter("method", method, f"one of {METHODS}")
    names = numeric_columns(df, columns, index)
    if len(names) < 2:
        raise InvalidParameter("columns", names, "at least two numeric columns")
    values = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(names)])
    varies = values.agg(*[(F.min(c) < F.max(c)).alias(c) for c in values.columns]).first()
    pairs = {"pearson": _pearson, "spearman": _spearman, "kendall": _kendall}[method](values, len(names))
    rows = [(name, name, 1.0 if varies[f"v{i}"] else 0.0) for i, name in enumerate(names)]
    rows += [(names[i], names[j], r) for (i, j), r in pairs.items()]
    rows += [(names[j], names[i], r) for (i, j), r in pairs.items()]
    if min_correlation is not None:
        rows = [x for x in rows if abs(x[2]) >= abs(min_correlation) or x[0] == x[1]]
    # one row per pair of columns
    return df.sparkSession.createDataFrame(sorted(rows), "col1 string, col2 string, r double")


def _all_pairs(k):
    return list(itertools.combinations(range(k), 2))


def _ratio(cov, sx, sy):
    if cov is None or not sx or not sy:
        return 0.0
    return max(-1.0, min(1.0, cov / (sx * sy)))


def _pearson(values: DataFrame, k: int) -> dict:
    """All pairs from one aggregate (sliced for very wide tables)."""
    out, pairs = {}, _all_pairs(k)
    for at in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[at : at + PAIRS_PER_JOB]
        row = values.agg(*[
            F.struct(
                F.covar_pop(f"v{i}", f"v{j}").alias("c"),
                F.stddev_pop(F.when(F.col(f"v{j}").isNotNull(), F.col(f"v{i}"))).alias("x"),
                F.stddev_pop(F.when(F.col(f"v{i}").isNotNull(), F.col(f"v{j}"))).alias("y"),
            ).alias(f"p{n}") for n, (i, j) in enumerate(part)
        ]).first()
        out.update({pair: _ratio(*row[f"p{n}"]) for n, pair in enumerate(part)})
    return out


def _spearman(values: DataFrame, k: int) -> dict:
    """Columns without nulls are ranked once together; all pairs that have nulls are ranked in one pass, on their complete rows."""
    _, nulls = null_counts(values, values.columns)
    full = [i for i in range(k) if nulls[f"v{i}"] == 0]
    out = _rank_correlations(values.select(*[f"v{i}" for i in full]), full) if len(full) > 1 else {}
    rest = [pair for pair in _all_pairs(k) if pair not in out]
    for at in range(0, len(rest), PAIRS_PER_JOB):
        out |= _paired_rank_correlations(values, rest[at : at + PAIRS_PER_JOB])
    return out


def _grouped(
    table: DataFrame, cells: Callable[[DataFrame], DataFrame], keys: Sequence[str], sums: dict[str, Column], task_rows: int | None = None,
) -> DataFrame:
    """``sums`` of the rows that ``cells`` makes of ``table``, by ``keys``; ``cells`` passes on a column ``slot``.

    Few groups are summed where they are read. Else a task would hold as many as a file's split has, so the table is first dealt
    out by slots that have nothing to do with its values: groups are summed inside each slot, and then over the slots.
    """
    task_rows = task_rows or TASK_ROWS
    marked = cells(table.withColumn("slot", F.lit(0)))
    some = marked.select(F.xxhash64(*keys).alias("hash")).filter(F.col("hash") % ESTIMATED == 0)
    if some.agg(F.approx_count_distinct("hash")).first()[0] * ESTIMATED <= task_rows:
        return marked.groupBy(*keys).agg(*[c.alias(name) for name, c in sums.items()])
    parts = partitions_for(table, marked.count(), task_rows)
    slot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts * SLOTS))
    inside = cells(table.withColumn("slot", slot).repartition(parts, "slot")).groupBy("slot", *keys).agg(*[c.alias(name) for name, c in sums.items()])
    met = inside.withColumn("hash", F.xxhash64(*keys)).repartition(parts, "hash")
    return met.groupBy("hash", *keys).agg(*[F.sum(name).alias(name) for name in sums]).drop("hash")


def _cells(values: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(pair number p, x, y, count w) of the complete rows of every pair, written; equal rows are merged."""
    both = [
        F.when(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull(), F.struct(F.lit(p).alias("p"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y")))
        for p, (i, j) in enumerate(pairs)
    ]
    cells = lambda rows: rows.select("slot", F.explode(F.filter(F.array(*both), lambda c: c.isNotNull())).alias("c")).select("slot", "c.*")
    return keep(_grouped(values, cells, ["p", "x", "y"], {"w": F.count(F.lit(1))}))


def _paired_rank_correlations(values: DataFrame, pairs: list[tuple[int, int]]) -> dict:
    """As ``_rank_correlations``, with every step keyed by the number of the pair."""
    cells = _cells(values, pairs)
    sides = F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("v")) for s in ("x", "y")])
    halves = lambda rows: rows.select("slot", "p", "w", F.explode(sides).alias("c")).select("slot", "p", "w", "c.*")
    hist = _grouped(cells, halves, ["p", "s", "v"], {"n": F.sum("w"), "rows": F.count(F.lit(1))})
    ranks = keep(
        running_sums(hist, ["p", "s"], ["v"], {"before": "n"}, {"total": "before"})
        .select("p", "s", "v", "rows", (F.col("before") + F.col("n") / F.lit(2.0) - F.col("total") / F.lit(2.0)).alias("dev"))
    )
    ranked = cells
    for s in ("x", "y"):
        mine = ranks.filter(F.col("s") == s).select("p", F.col("v").alias(s), F.col("dev").alias(f"d{s}"), F.col("rows").alias("__rows__"))
        ranked = lookup_join(ranked, mine, ["p", s], "__rows__", task_rows=TASK_ROWS).drop("__rows__")
    sums = ranked.groupBy("p").agg(*[F.sum(F.col(f"d{a}") * F.col(f"d{b}") * F.col("w")).alias(a + b) for a, b in ("xy", "xx", "yy")])
    found = {r["p"]: _ratio(r["xy"], math.sqrt(r["xx"]), math.sqrt(r["yy"])) for r in sums.collect()}  # one row per pair
    return {pair: found.get(p, 0.0) for p, pair in enumerate(pairs)}


def _rank_correlations(complete: DataFrame, numbers: list[int]) -> dict:
    """Pearson on average ranks.

    Equal rows are merged first and numbered where they are written. Ranks come from running counts over each column's distinct
    values, all columns in one pass. One join on (column, value), with hot values salted, brings all ranks to the cells of the rows,
    and the cells of a row meet again by its number: one join and one grouping, however many columns there are. The mean rank
    (n + 1) / 2 is known, so one weighted sum per pair is all that is left. What a task sorts or groups is bounded by rows.
    """
    cols = [f"v{i}" for i in numbers]
    merged = _grouped(complete, lambda rows: rows, cols, {"w": F.count(F.lit(1))})
    rows = keep(merged.withColumn("row", F.monotonically_increasing_id()))
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in numbers])
    cells = rows.select("row", "w", F.explode(each).alias("x")).select("row", "w", "x.c", "x.v")
    slotted = lambda rows: rows.select("slot", "w", F.explode(each).alias("x")).select("slot", "w", "x.*")
    hist = _grouped(rows, slotted, ["c", "v"], {"n": F.sum("w"), "rows": F.count(F.lit(1))})
    ranks = keep(
        running_sums(hist, ["c"], ["v"], {"before": "n"}, {"total": "before"})
        .select("c", "v", "rows", (F.col("before") + F.col("n") / F.lit(2.0) - F.col("total") / F.lit(2.0)).alias("dev"))
    )
    placed = lookup_join(cells, ranks, ["c", "v"], "rows", task_rows=TASK_ROWS)
    placed = placed.repartition(partitions_for(rows, rows.count(), TASK_ROWS), "row")  # a task before the shuffle has hardly two cells of a row
    ranked = placed.groupBy("row").agg(F.first("w").alias("w"), *[F.max(F.when(F.col("c") == i, F.col("dev"))).alias(f"d{i}") for i in numbers])
    pairs = list(itertools.combinations_with_replacement(numbers, 2))
    if len(pairs) > PAIRS_PER_JOB:
        ranked = keep(ranked)
    sums = {}
    for at in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[at : at + PAIRS_PER_JOB]
        row = ranked.agg(*[F.sum(F.col(f"d{i}") * F.col(f"d{j}") * F.col("w")).alias(f"p{m}") for m, (i, j) in enumerate(part)]).first()
        sums.update({pair: row[f"p{m}"] for m, pair in enumerate(part)})
    return {
        (i, j): _ratio(sums[i, j], math.sqrt(sums[i, i] or 0.0), math.sqrt(sums[j, j] or 0.0))
        for i, j in pairs if i != j
    }


def _kendall(values: DataFrame, k: int) -> dict:
    out, pairs = {}, _all_pairs(k)
    for at in range(0, len(pairs), PAIRS_PER_JOB):
        out |= _tau_b(values, pairs[at : at + PAIRS_PER_JOB])
    return out


def _tau_b(values: DataFrame, pairs: list[tuple[int, int]]) -> dict:
    """tau-b of all pairs in O(n log n) steps for each, without pairing rows; every step is keyed by the number of the pair.

    Concordant pairs are counted over a grid; discordant ones follow from the ties.
    """
    cells = _cells(values, pairs)
    ties = lambda c: F.sum(_product(F.col(c), F.col(c) - 1))
    rows = cells.groupBy("p").agg(ties("w").alias("both"), F.sum("w").alias("n"))
    sides = {
        c: cells.groupBy("p", c).agg(F.sum("w").alias("t")).groupBy("p").agg(ties("t").alias(f"by_{c}")) for c in ("x", "y")
    }
    facts = {r["p"]: r for r in rows.join(sides["x"], "p").join(sides["y"], "p").collect()}  # one row per pair
    counted = _concordant(cells) if facts else {}
    out = {}
    for p, pair in enumerate(pairs):
        out[pair] = 0.0
        if p in facts:
            n, by_x, by_y, both = (int(facts[p][c]) for c in ("n", "by_x", "by_y", "both"))
            every = n * (n - 1)  # each counted twice, like the ties
            if every not in (by_x, by_y):
                concordant = 2 * counted.get(p, 0)
                discordant = every - by_x - by_y + both - concordant
                out[pair] = (concordant - discordant) / math.sqrt((every - by_x) * (every - by_y))
    return out


def _concordant(cells: DataFrame, part_cells: int = PART_CELLS) -> dict[int, int]:
    """Concordant pairs of rows by the number of the pair of columns, from written ``cells`` (p, x, y, w), distinct in p, x, y.

    Order the cells by (x up, y down) and by (y up, x down): a pair of rows is concordant exactly if one cell is before the other
    in both orders. Each order is cut into ranges of about ``part_cells`` cells, which no hot value can widen because the whole cell is the key.
    Pairs in one range of x are counted in its task, pairs in one range of y but different ranges of x in that one's. What is
    left lies in different ranges of both and depends on the cells' weights in each square of the grid only: the same
    question about far fewer cells, at most the square of the number of ranges. Cells are shuffled twice, whatever their values.
    """
    total: dict[int, int] = {}
    while (n := cells.count()) > 0:
        parts = -(-n // max(part_cells, 4 * math.isqrt(n)))  # so a grid has at most a sixteenth of the cells
        up, down = F.col("x").asc(), F.col("y").desc()
        by_x = cells.repartitionByRange(parts, "p", up, down) if parts > 1 else cells.coalesce(1)
        by_x = by_x.sortWithinPartitions("p", up, down).withColumn("a", F.spark_partition_id())
        by_x = keep(by_x.select("p", "x", "y", "w", "a").mapInArrow(_count_by_x, "p int, x double, y double, w long, a int, pairs decimal(38,0)"))
        _add_counts(total, by_x)
        if parts == 1:
            break
        by_y = by_x.where("pairs is null").repartitionByRange(parts, "p", F.col("y").asc(), F.col("x").desc())
        by_y = by_y.sortWithinPartitions("p", F.col("y").asc(), F.col("x").desc()).withColumn("b", F.spark_partition_id())
        grid = keep(by_y.select("p", "w", "a", "b").mapInArrow(_count_by_y, "p int, x double, y double, w long, pairs decimal(38,0)"))
        _add_counts(total, grid)
        cells = grid.where("pairs is null").select("p", "x", "y", "w")
    return total


def _add_counts(total: dict[int, int], counted: DataFrame) -> None:
    for r in counted.where("pairs is not null").groupBy("p").agg(F.sum("pairs").alias("pairs")).collect():  # one row per pair of columns
        total[r["p"]] = total.get(r["p"], 0) + int(r["pairs"])


def _count_by_x(batches):
    """The cells of one range of x unchanged, and for each pair of columns a row with the number of pairs inside the range."""
    held = []
    for batch in batches:
        held.append(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.decimal128(38, 0))], [*batch.schema.names, "pairs"])
    for p, cell in _runs(held):
        order = np.lexsort((-cell["x"], cell["y"]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield _summary(p, ascending_pairs(rank, cell["w"]), ["x", "y", "w", "a"], [pa.float64(), pa.float64(), pa.int64(), pa.int32()])


def _count_by_y(batches):
    """For each pair of columns the weight of each square of one range of y, and a row with the number of pairs inside the range whose ranges
    of x differ: taken by range of x, falling inside it, so that no two cells of one range of x ascend."""
    for p, cell in _runs(list(batches)):
        order = np.lexsort((-np.arange(len(cell["a"])), cell["a"]))
        yield _summary(p, ascending_pairs(order, cell["w"][order]), ["x", "y", "w"], [pa.float64(), pa.float64(), pa.int64()])
        a, at = np.unique(cell["a"], return_inverse=True)
        weight = np.zeros(len(a), np.int64)
        np.add.at(weight, at, cell["w"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), p, np.int32)), pa.array(a.astype(float)), pa.array(np.full(len(a), float(cell["b"][0]))), pa.array(weight),
             pa.nulls(len(a), pa.decimal128(38, 0))], ["p", "x", "y", "w", "pairs"],
        )


def _runs(batches):
    """The number of each pair of columns in sorted batches, and its columns as arrays."""
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    columns = {c: table.column(c).to_numpy() for c in table.column_names}
    cuts = [0, *(np.flatnonzero(np.diff(columns["p"])) + 1).tolist(), table.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield int(columns["p"][low]), {c: v[low:high] for c, v in columns.items()}


def _summary(p, pairs, others, types):
    arrays = [pa.array([p], pa.int32()), *(pa.nulls(1, kind) for kind in types), pa.array([decimal.Decimal(pairs)], pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays(arrays, ["p", *others, "pairs"])


def ascending_pairs(rank: np.ndarray, weight: np.ndarray) -> int:
    """The sum of products of weights over all i < j with ``rank[i] < rank[j]``; ``rank`` holds 0 to n - 1 in some order.

    Two ranks differ first at one binary digit. Ranks that agree above it stand together, in their order; there the sum of the weights so
    far of ranks with a 0 meets each rank with a 1. Then those with a 0 go before those with a 1, for the next digit.
    """
    n = len(rank)
    small = int(weight.sum()) < 1 << 31  # else products don't fit in 64 bits
    total, place = 0, np.arange(n)
    rank, weight = rank.astype(np.int64), weight.astype(np.int64)
    for level in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        one = (rank >> level) & 1 == 1
        start = (rank >> (level + 1)) << (level + 1)  # ranks have no gaps, so a group stands where its ranks begin
        zero_weight = np.concatenate([[0], np.cumsum(np.where(one, 0, weight))])
        met = (zero_weight[:-1] - zero_weight[start])[one]
        total += int(met @ weight[one]) if small else sum(map(int.__mul__, met.tolist(), weight[one].tolist()))
        zeros = np.concatenate([[0], np.cumsum(~one)])
        before = zeros[:-1] - zeros[start]
        target = np.where(one, start + (1 << level) + (place - start - before), start + before)
        moved_rank, moved_weight = np.empty_like(rank), np.empty_like(weight)
        moved_rank[target], moved_weight[target] = rank, weight
        rank, weight = moved_rank, moved_weight
    return total


def _product(a, b):
    """An exact product of two counts."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
