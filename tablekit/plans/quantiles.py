"""Exact, linearly interpolated quantiles of whole columns, without a shuffle of the values.

``percentile`` keeps every distinct value of a column in one buffer, which a large column does not survive. Here a
bounded sketch brackets each wanted rank, a second pass counts the rows below and on the ends of the bracket, and the
search goes on inside until a bracket holds few enough values to count one by one, in tasks. Each round shrinks a bracket more than a
thousandfold, so 10**12 rows need about seven scans of the column; the counts make the answer exact whatever the
sketch's error.
"""

from __future__ import annotations

import math
import operator as op
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import as_double, combined, ref

SKETCH_SIZE = 32768      # values per sketch level; its rank error is below REACH
REACH = 2e-4             # how far the ends of a bracket lie from the wanted rank, as a share of the rows
SMALL_ROWS = 200_000     # columns with at most this many values use the built-in exact percentile
LIST_LIMIT = 100_000     # a bracket with at most this many values is counted value by value
COLUMNS_PER_JOB = 20     # keeps the generated code of one aggregate small


@dataclass
class _Target:
    """One wanted rank of one column and the open interval of values that is known to hold it."""

    column: str
    rank: int
    low: object = None          # None: unbounded
    high: object = None
    below: int = 0              # values at or below ``low``
    inside: int = 0             # values strictly between
    found: object = None
    ends: list = field(default_factory=list)

    @property
    def bracket(self) -> tuple:
        return self.column, self.low, self.high

    def within(self) -> Column:
        c = ref(self.column)
        cond = c.isNotNull()
        if self.low is not None:
            cond = cond & (c > F.lit(self.low))
        if self.high is not None:
            cond = cond & (c < F.lit(self.high))
        return cond


def quantiles(
    df: DataFrame, columns: Sequence[str], ps: Sequence[float], small: int | None = None, listed: int | None = None,
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles on the driver (schema-sized): ``{column: {p: value}}``; None for an all-null column.

    ``small`` and ``listed`` stand in for ``SMALL_ROWS`` and ``LIST_LIMIT``.
    """
    return quantiles_and(df, columns, ps, {}, small, listed)[0]


def quantiles_and(
    df: DataFrame, columns: Sequence[str], ps: Sequence[float], extras: dict[object, Column], small: int | None = None, listed: int | None = None,
) -> tuple[dict, dict]:
    """The quantiles, and other aggregates of ``df`` from the same first scan."""
    found, more, columns = {}, {}, list(columns)
    for at in range(0, max(len(columns), 1), COLUMNS_PER_JOB):
        part = columns[at : at + COLUMNS_PER_JOB]
        q, x = _quantiles(df, part, list(ps), extras if at == 0 else {}, small, listed)
        found, more = found | q, more | x
    return found, more


def _ends(c: Column, ranks: Sequence[float]) -> Column:
    """Values near the ranks, from a bounded sketch; null when there is no value."""
    sketch = F.kll_sketch_agg_double(c, F.lit(SKETCH_SIZE))
    return F.when(F.count(c) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(r) for r in ranks])))


def _around(rank: float) -> list[float]:
    return [max(0.0, rank - REACH), min(1.0, rank + REACH)]


def _quantiles(df, columns, ps, extras=None, small=None, listed=None):
    small = SMALL_ROWS if small is None else small
    listed = LIST_LIMIT if listed is None else listed
    extras = extras or {}
    if not columns and not extras:
        return {}, {}
    near = sorted({r for p in ps for r in _around(p)})
    first = df.agg(
        F.count(F.lit(1)).alias("rows"), *[v.alias(f"x{i}") for i, v in enumerate(extras.values())],
        *[F.count(as_double(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[_ends(as_double(df, c), near).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    more = {k: first[f"x{i}"] for i, k in enumerate(extras)}
    counts = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    out = {c: {p: None for p in ps} for c in columns}
    vals = df.select(*[as_double(df, c).alias(c) for c in columns])

    few = [c for c in columns if 0 < counts[c] <= small]
    if few:
        row = vals.agg(*[F.percentile(ref(c), list(ps)).alias(f"q{i}") for i, c in enumerate(few)]).first()
        for i, c in enumerate(few):
            out[c] = dict(zip(ps, row[f"q{i}"]))

    targets = {}
    for i, c in enumerate(columns):
        for p in ps if counts[c] > small else ():
            ends = [first[f"s{i}"][near.index(r)] for r in _around(p)]
            for rank in _ranks(counts[c], p):
                targets.setdefault((c, rank), _Target(c, rank, inside=counts[c], ends=ends))
    _resolve(vals, list(targets.values()), listed)
    for c in dict.fromkeys(c for c, _ in targets):
        for p in ps:
            lo, hi = _ranks(counts[c], p)
            a, b = targets[c, lo].found, targets[c, hi].found
            out[c][p] = a + (b - a) * ((counts[c] - 1) * p - lo)
    return out, more


def _ranks(n: int, p: float) -> tuple[int, int]:
    at = (n - 1) * p
    return math.floor(at), math.ceil(at)


def _resolve(vals: DataFrame, targets: list[_Target], listed: int) -> None:
    _narrow(vals, targets)
    while wide := [t for t in targets if t.found is None and t.inside > listed]:
        inner = vals.filter(_any_within(wide))
        sketches = inner.agg(*[
            _ends(F.when(t.within(), ref(t.column)), _around((t.rank - t.below) / t.inside)).alias(f"s{i}")
            for i, t in enumerate(wide)
        ]).first()
        for i, t in enumerate(wide):
            t.ends = list(sketches[f"s{i}"])
        _narrow(vals, wide)
    _list(vals, [t for t in targets if t.found is None])


def _any_within(targets: list[_Target]) -> Column:
    return combined(op.or_, [t.within() for t in targets])


def _narrow(vals: DataFrame, targets: list[_Target]) -> None:
    """Count around the sketched ends of every bracket and keep the part that holds the rank."""
    if not targets:
        return
    ends = list(dict.fromkeys((t.column, e) for t in targets for e in t.ends))
    counts = vals.agg(*[
        F.struct(F.count_if(ref(c) < F.lit(e)), F.count_if(ref(c) == F.lit(e))).alias(f"e{i}")
        for i, (c, e) in enumerate(ends)
    ]).first()
    seen = {end: tuple(counts[i]) for i, end in enumerate(ends)}
    for t in targets:
        a, b = t.ends
        (below_a, at_a), (below_b, at_b) = seen[t.column, a], seen[t.column, b]
        if below_a <= t.rank < below_a + at_a:
            t.found = a
        elif below_b <= t.rank < below_b + at_b:
            t.found = b
        elif t.rank < below_a:
            t.high, t.inside = a, below_a - t.below
        elif t.rank >= below_b + at_b:
            t.inside -= below_b + at_b - t.below
            t.low, t.below = b, below_b + at_b
        else:
            t.low, t.high, t.below = a, b, below_a + at_a
            t.inside = below_b - t.below


def _list(vals: DataFrame, targets: list[_Target]) -> None:
    """Read off the ranks from running counts over the brackets' values; each bracket holds at most ``LIST_LIMIT`` rows. A row per rank is collected."""
    if not targets:
        return
    brackets = list(dict.fromkeys(t.bracket for t in targets))
    of = {t.bracket: t for t in targets}
    tagged = F.array(*[
        F.when(of[b].within(), F.struct(F.lit(i).alias("i"), ref(of[b].column).alias("v"))) for i, b in enumerate(brackets)
    ])
    counted = (
        vals.filter(_any_within(list(of.values())))
        .select(F.explode(F.filter(tagged, lambda x: x.isNotNull())).alias("x"))
        .groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    )
    before = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = F.array(*[
        F.when((F.col("i") == brackets.index(t.bracket)) & (F.col("before") <= t.rank - t.below) & (F.col("before") + F.col("n") > t.rank - t.below), F.lit(k))
        for k, t in enumerate(targets)
    ])
    for k, v in placed.select(F.explode(F.array_compact(wanted)).alias("k"), "v").collect():
        targets[k].found = v


def scaled_bounds(q: dict[float, float | None], factor: float) -> tuple[float, float, float] | None:
    """(lower, upper, iqr) of the quartile rule; None when the column holds no value."""
    if q[0.25] is None:
        return None
    iqr = q[0.75] - q[0.25]
    return q[0.25] - factor * iqr, q[0.75] + factor * iqr, iqr
