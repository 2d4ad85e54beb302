"""Anomalies: statistical outliers, rare or oddly formatted text, suspicious gaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import InvalidParameter
from ..plans.columns import INDEX, as_double, beyond, data_columns, missing, numeric_columns, ref, require, text_columns
from ..plans.joins import bounded
from ..plans.metrics import null_counts, text_key, texts_of, value_histogram
from ..plans.order import BLOCK_BITS
from ..plans.quantiles import quantiles_and, scaled_bounds
from ..plans.store import keep
from ..settings import DEFAULTS, Thresholds

METHODS = ("statistical", "pattern", "missing")
# Common values are broadcast up to this many; there are at most 1 / share of them per column.
BROADCAST_VALUES = 1_000_000


def _hits(df: DataFrame, index: str, hits: dict[str, Column], value) -> DataFrame:
    cells = [
        F.when(hit, F.struct(F.lit(c).alias("column"), value(c).alias("value"))) for c, hit in hits.items()
    ]
    found = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return df.select(F.col(index).cast("long").alias(index), F.explode(found).alias("x")).select("x.column", index, "x.value")


def _empty(df: DataFrame, index: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"column string, `{index}` bigint, value string")


def _statistical_rules(df, names, sensitivity):
    """Per numeric column with values: (rule, mean, std, lower, upper)."""
    z_limit, factor = 3 * (1 - sensitivity + 0.5), 1.5 * (2 - sensitivity)
    wanted = {}
    for c in names:
        v = as_double(df, c)
        wanted |= {(c, "mean"): F.avg(v), (c, "std"): F.coalesce(F.stddev_samp(v), F.lit(0.0))}
    found, facts = quantiles_and(df, names, (0.25, 0.75), wanted)
    rules = {}
    for name, q in found.items():
        bounds = scaled_bounds(q, factor)
        if bounds is None:
            continue
        c, mean, std = as_double(df, name), facts[name, "mean"], facts[name, "std"]
        hit = beyond(df, name, *bounds[:2])[1]
        if std > 0:
            hit = hit | (F.abs((c - F.lit(mean)) / F.lit(std)) > F.lit(z_limit))
        rules[name] = (hit, mean, std, bounds[0], bounds[1])
    return rules


def statistical_anomalies(
    df: DataFrame, columns: Sequence[str] | None = None, sensitivity: float = 0.95, index: str = INDEX
) -> DataFrame:
    """(column, row index, value) beyond the z-score or the quartile bound, both tightened by ``sensitivity``."""
    rules = _statistical_rules(df, numeric_columns(df, columns, index), sensitivity)
    if not rules:
        return _empty(df, index)
    return _hits(df, index, {c: r[0] for c, r in rules.items()}, lambda c: ref(c).cast("string"))


def _is_upper(c):
    return (c == F.upper(c)) & (c != F.lower(c))


def _is_lower(c):
    return (c == F.lower(c)) & (c != F.upper(c))


def _text_facts(df: DataFrame, names: Sequence[str], sensitivity: float, thresholds: Thresholds):
    """The histogram of the text columns and, per column with rare values, its total and common letter case."""
    hist = keep(value_histogram(df, names, ordered=True).filter("h1 IS NOT NULL").select("c", "h1", "h2", "p", "n"))
    limit = (1 - sensitivity) * 0.01
    totals = hist.groupBy("c").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    totals = {r["c"]: r for r in totals.collect()}
    if not totals:
        return hist, {}, None
    # one CASE branch per column
    total = F.lit(None).cast("long")
    for c, r in totals.items():
        total = F.when(F.col("c") == c, F.lit(r["total"])).otherwise(total)
    rare = (F.col("n") / total) < F.lit(limit)
    rare_count = {r["c"]: r["k"] for r in hist.filter(rare).groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}
    # Texts beyond their first bytes only matter among those that are alike so far.
    so_far = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("p").asc())
    chosen = keep(hist.withColumn("rk", F.rank().over(so_far)).filter(F.col("rk") <= thresholds.top_categories).drop("rk"))
    first = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("s").asc())
    top = (
        chosen.join(texts_of(df, names, chosen.select("c", "h1", "h2")), ["c", "h1", "h2"])
        .withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= thresholds.top_categories)
        .groupBy("c").agg(F.count_if(_is_upper(F.col("s"))).alias("up"), F.count_if(_is_lower(F.col("s"))).alias("low"))
    )
    case = {}
    for r in top.collect():
        if r["c"] in rare_count and totals[r["c"]]["distinct"] > thresholds.top_categories:
            agreeing = thresholds.top_categories_agreeing
            case[r["c"]] = "uppercase" if r["up"] > agreeing else "lowercase" if r["low"] > agreeing else None
    return hist, {c: (rare_count[c], case.get(c)) for c in rare_count}, rare


def pattern_anomalies(
    df: DataFrame, columns: Sequence[str] | None = None, sensitivity: float = 0.95, index: str = INDEX,
    thresholds: Thresholds = DEFAULTS,
) -> DataFrame:
    """(column, row index, value) of rare values, and of values that break the letter case most frequent values share.

    Rows are compared with the *common* values: at most 1 / share of them exist per column, so they are broadcast and
    the table is not shuffled for the lookup, whatever value is hot.
    """
    return _pattern(df, text_columns(df, columns, index), sensitivity, index, thresholds)[0]


def _pattern(df, names, sensitivity, index, thresholds):
    if not names:
        return _empty(df, index), {}
    hist, facts, rare = _text_facts(df, names, sensitivity, thresholds)
    if not facts:
        return _empty(df, index), {}
    watched = list(facts)
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(names[c]).alias("column"), ref(names[c]).alias("s")) for c in watched])
    rows = df.select(F.col(index).cast("long").alias(index), F.explode(cells).alias("x")).select(index, "x.*")
    rows = rows.filter("s IS NOT NULL").withColumns({"h1": text_key(F.col("s"))[0], "h2": text_key(F.col("s"))[1]})
    common = hist.filter(~rare & F.col("c").isin(watched)).select("c", "h1", "h2", F.lit(True).alias("common"))
    if len(watched) / ((1 - sensitivity) * 0.01) <= BROADCAST_VALUES:
        common = bounded(common, BROADCAST_VALUES)
    odd_case = F.lit(False)
    for c, (_, case) in facts.items():
        if case:
            fits = _is_upper(F.col("s")) if case == "uppercase" else _is_lower(F.col("s"))
            odd_case = odd_case | ((F.col("c") == c) & ~fits)
    found = rows.join(common, ["c", "h1", "h2"], "left").filter(F.col("common").isNull() | odd_case)
    return found.select("column", index, F.col("s").alias("value")), {names[c]: f for c, f in facts.items()}


def _gap_columns(df, names, thresholds):
    """The columns that are partly empty: (nulls, share)."""
    n, nulls = null_counts(df, names)
    return {c: (k, k / n) for c, k in nulls.items() if k > 0 and k / n < thresholds.low_completeness}


def null_clusters(
    df: DataFrame, columns: Sequence[str], index: str = INDEX, bits: int = BLOCK_BITS
) -> DataFrame:
    """(column, clusters): runs of at least two null cells in consecutive rows of the dense row index.

    Only the null cells are shuffled, by blocks of rows; a cell at the edge of a block is copied to the next block, so
    that every block sees its neighbours.
    """
    require(df, [index])
    mask, at = (1 << bits) - 1, F.col(index)
    block = F.shiftright(at.cast("long"), bits)
    copies = F.filter(F.array(
        F.struct(block.alias("b"), F.lit(False).alias("ghost")),
        F.when(at.bitwiseAND(mask) == mask, F.struct((block + 1).alias("b"), F.lit(True).alias("ghost"))),
        F.when(at.bitwiseAND(mask) == 0, F.struct((block - 1).alias("b"), F.lit(True).alias("ghost"))),
    ), lambda x: x.isNotNull())
    empty = F.filter(F.array(*[F.when(missing(df, c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    cells = df.select(at.cast("long").alias(index), F.explode(empty).alias("column")).select(
        index, "column", F.explode(copies).alias("x")
    ).select(index, "column", "x.*")
    near = Window.partitionBy("column", "b").orderBy(index)
    starts = (
        cells.withColumns({"prev": F.lag(index).over(near), "next": F.lead(index).over(near)})
        .filter(~F.col("ghost") & (F.col("next") == at + 1) & (F.col("prev").isNull() | (F.col("prev") != at - 1)))
    )
    return starts.groupBy("column").agg(F.count(F.lit(1)).alias("clusters"))


def missing_anomalies(
    df: DataFrame, columns: Sequence[str] | None = None, index: str = INDEX, thresholds: Thresholds = DEFAULTS
) -> DataFrame:
    """(column, missing_count, missing_ratio, sequential_clusters, pattern) of suspicious partly empty columns."""
    gaps = _gap_columns(df, data_columns(df, columns, index), thresholds)
    clusters = {r["column"]: r["clusters"] for r in null_clusters(df, list(gaps), index).collect()} if gaps else {}
    rows = []
    for c, (nulls, ratio) in gaps.items():
        runs = clusters.get(c, 0)
        clustered = min(runs, 1) > nulls * thresholds.cluster_share
        if clustered or thresholds.missing_low < ratio < thresholds.missing_high:
            rows.append((c, nulls, round(ratio, 4), runs, "clustered" if runs else "random"))
    return df.sparkSession.createDataFrame(
        rows, "column string, missing_count bigint, missing_ratio double, sequential_clusters bigint, pattern string"
    )


@dataclass(frozen=True)
class AnomalyReport:
    """``cells``: every anomalous cell. ``by_method``, ``by_column``: one row per (method and) column. ``summary``: one row."""

    cells: DataFrame
    by_method: DataFrame
    by_column: DataFrame
    summary: DataFrame


_BY_METHOD = (
    "method string, column string, anomaly_count bigint, mean double, std double, lower_bound double, "
    "upper_bound double, expected_pattern string, missing_ratio double, sequential_clusters bigint, pattern string"
)


def find_anomalies(
    df: DataFrame, columns: Sequence[str] | None = None, sensitivity: float = 0.95,
    methods: Sequence[str] | None = None, index: str = INDEX, thresholds: Thresholds = DEFAULTS,
) -> AnomalyReport:
    if not 0 <= sensitivity <= 1:
        raise InvalidParameter("sensitivity", sensitivity, "0 to 1")
    methods = list(methods or METHODS)
    for m in methods:
        if m not in METHODS:
            raise InvalidParameter("methods", m, f"one of {METHODS}")
    names = data_columns(df, columns, index)
    cells, rules, facts = _empty(df, index).withColumn("method", F.lit("")), {}, {}
    if "statistical" in methods:
        rules = _statistical_rules(df, numeric_columns(df, names, index), sensitivity)
        if rules:
            found = _hits(df, index, {c: r[0] for c, r in rules.items()}, lambda c: ref(c).cast("string"))
            cells = cells.unionByName(found.withColumn("method", F.lit("statistical")))
    if "pattern" in methods:
        found, facts = _pattern(df, text_columns(df, names, index), sensitivity, index, thresholds)
        cells = cells.unionByName(found.withColumn("method", F.lit("pattern")))
    cells = keep(cells)
    counted = {(r["method"], r["column"]): r["n"]
               for r in cells.groupBy("method", "column").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for c in names:
        n = counted.get(("statistical", c))
        if n:
            rows.append(("statistical", c, n, *[float(x) for x in rules[c][1:]], None, None, None, None))
    for c in names:
        n = counted.get(("pattern", c))
        if n:
            rows.append(("pattern", c, n, None, None, None, None, facts[c][1], None, None, None))
    if "missing" in methods:
        for r in missing_anomalies(df, names, index, thresholds).collect():
            rows.append(("missing", r["column"], r["missing_count"], None, None, None, None, None,
                         r["missing_ratio"], r["sequential_clusters"], r["pattern"]))
    first = {}
    for row in rows:  # in the order of METHODS
        first.setdefault(row[1], row)
    spark = df.sparkSession
    total = sum(counted.values())
    summary = cells.agg(F.count_distinct(index).alias("affected_rows")).select(
        F.lit(total).cast("long").alias("total_anomalies"), "affected_rows",
        F.lit(",".join(sorted(first))).alias("affected_columns"),
    )
    return AnomalyReport(
        cells.select("method", "column", index, "value"), spark.createDataFrame(rows, _BY_METHOD),
        spark.createDataFrame(list(first.values()), _BY_METHOD), summary,
    )
