"""Shards of documents as leaves of a k-d tree over their metadata.

A node that holds more than one shard's share of bytes is split along its widest dimension, measured against the whole table's range, at the
weighted median (or another quantile, where the number of shards is odd). Medians are searched in a distributed way: every task adds up
bytes in bins between a lower and an upper bound, the bin that holds the median becomes the next pair of bounds, and all nodes of a level are
searched in one pass. Only one row a node reaches the driver, and no document is shuffled for the tree.

Points with equal coordinates are ordered by the hash of their text and then by their place in a written table, so that a median always exists.
Equal texts have equal coordinates: the smallest of each dimension. They stay together unless a cut has to go through a group that is heavier than
``WHOLE`` of a shard.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..plans.joins import bounded, lookup_join
from ..plans.store import keep

#: Bins of one pass over all nodes that are searched.
BINS = 4096
#: The share of a shard's bytes up to which a cut goes round a group of equal texts.
WHOLE = 1 / 128
#: Rows that are numbered in one window.
BLOCK_BITS = 17


def _coordinate(value: Column, kind: T.DataType) -> Column:
    """A number in the order of the values: of texts the first six bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.substring(F.hex(value.cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")
    number = F.unix_date(value) if isinstance(kind, T.DateType) else value
    number = number.cast("double")
    return F.when(F.isnan(number), None).otherwise(F.greatest(F.least(number, F.lit(1e300)), F.lit(-1e300)))


class _Tree:
    """The points of a table and the nodes found so far; a node is named by the first of its shards."""

    def __init__(self, points: DataFrame, dims: int, shards: int, whole: float, bins: int):
        self.spark, self.points, self.dims, self.bins = points.sparkSession, points, dims, bins
        self.nodes = {0: shards}
        self.whole = whole
        self.placed = points.withColumn("node", F.lit(0))
        self.ranges: list[float] | None = None

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def grow(self) -> None:
        """Levels of splits until every node is one shard."""
        while any(n > 1 for n in self.nodes.values()):
            self._split([k for k, n in self.nodes.items() if n > 1])

    def _split(self, nodes: list[int]) -> None:
        edges = [f(f"d{k}").alias(f"{name}{k}") for k in range(self.dims) for name, f in (("low", F.min), ("high", F.max))]
        wanted = self._table([(n,) for n in nodes], "node int")
        stats = self.placed.join(wanted, "node", "left_semi").groupBy("node").agg(F.sum("size").alias("bytes"), *edges).collect()
        if self.ranges is None:
            self.ranges = [max((s[f"high{k}"] - s[f"low{k}"] for s in stats), default=0.0) for k in range(self.dims)]
        searched = {}
        for s in stats:
            wide = [(s[f"high{k}"] - s[f"low{k}"]) / self.ranges[k] if self.ranges[k] else 0.0 for k in range(self.dims)]
            dim = wide.index(max(wide))
            left = self.nodes[s["node"]] // 2
            searched[s["node"]] = _Search(dim, s[f"low{dim}"], s[f"high{dim}"], s["bytes"] * left / self.nodes[s["node"]], self.whole)
        while active := {n: s for n, s in searched.items() if s.cut is None}:
            for row in self._pass(active):
                searched[row["node"]].narrow(row["before"], row["bytes"], row["low"], row["high"])
        cuts = [(n, n + self.nodes[n] // 2, s.dim + 1, *s.cut) for n, s in searched.items()]
        for n in nodes:
            left = self.nodes[n] // 2
            self.nodes[n], self.nodes[n + left] = left, self.nodes[n] - left
        split = self._table(cuts, "node int, right int, dim int, at double, hash_at double, row_at double")
        here = F.element_at(F.array(*[F.col(f"d{k}") for k in range(self.dims)]), F.col("dim"))
        before = (here < F.col("at")) | (
            (here == F.col("at")) & ((F.col("hash") < F.col("hash_at")) | ((F.col("hash") == F.col("hash_at")) & (F.col("row") <= F.col("row_at"))))
        )
        moved = self.placed.join(split, "node", "left").withColumn("node", F.when(F.col("right").isNull() | before, F.col("node")).otherwise(F.col("right")))
        self.placed = moved.drop("right", "dim", "at", "hash_at", "row_at")

    def _pass(self, active: dict[int, "_Search"]) -> list:
        """For each node the bin that holds its median: bytes before and in it, least and greatest value."""
        bins = max(16, self.bins // len(active))
        rows = [(n, s.dim + 1, s.stage, s.low, s.high, s.at, s.hash_at, float(s.target - s.below)) for n, s in active.items()]
        state = self._table(rows, "node int, dim int, stage int, low double, high double, at double, hash_at double, wanted double")
        here = F.element_at(F.array(*[F.col(f"d{k}") for k in range(self.dims)]), F.col("dim"))
        value = F.when(F.col("stage") == 0, here).when(F.col("stage") == 1, F.col("hash")).otherwise(F.col("row").cast("double"))
        tied = ((F.col("stage") < 1) | (here == F.col("at"))) & ((F.col("stage") < 2) | (F.col("hash") == F.col("hash_at")))
        inside = self.placed.join(state, "node").where(tied).withColumn("value", value).where("value between low and high")
        place = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
        bin = F.when(F.col("high") > F.col("low"), F.least(F.floor(place * bins), F.lit(bins - 1))).otherwise(F.lit(0))
        found = inside.groupBy("node", "wanted", bin.alias("bin")).agg(F.sum("size").alias("bytes"), F.min("value").alias("low"), F.max("value").alias("high"))
        running = Window.partitionBy("node").orderBy("bin")  # a row a bin
        found = found.withColumn("upto", F.sum("bytes").over(running)).where(F.col("upto") >= F.col("wanted"))
        first = F.min(F.struct("bin", (F.col("upto") - F.col("bytes")).alias("before"), "bytes", "low", "high")).alias("found")
        return found.groupBy("node").agg(first).select("node", "found.*").collect()


class _Search:
    """Where one node is cut: first by coordinate, then by hash of the text, then by row."""

    def __init__(self, dim: int, low: float, high: float, target: float, whole: float):
        self.dim, self.stage, self.low, self.high = dim, 0, low, high
        self.target, self.below, self.whole = target, 0, whole
        self.at = self.hash_at = 0.0
        self.cut: tuple[float, float, float] | None = None

    def narrow(self, before: int, size: int, low: float, high: float) -> None:
        self.below += before
        self.low, self.high = low, high
        if low < high:
            return
        # All bytes of the bin lie at one value; the cut goes to its nearer side where it may not go through.
        nearer = float("inf") if self.target - self.below > size / 2 else -1.0
        if self.stage == 0:
            self.at, self.stage, self.low, self.high = low, 1, 0.0, 1.0
        elif self.stage == 1 and size > self.whole:
            self.hash_at, self.stage, self.low, self.high = low, 2, 0.0, float(1 << 63)
        elif self.stage == 1:
            self.cut = (self.at, low, nearer)
        else:
            self.cut = (self.at, self.hash_at, low if nearer > 0 else low - 0.5)


def points(docs: DataFrame, dims: Mapping[str, Column] | list[str], *, id: str, text: str, extra: list[str]) -> DataFrame:
    """A written table of the documents' coordinates ``d0``, ``d1``, ..., with ``row``, ``hash``, ``size`` and ``text_crc32``."""
    dims = dims if isinstance(dims, Mapping) else {c: F.col(c) for c in dims}
    held = docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        *[c.alias(f"d{k}") for k, c in enumerate(dims.values())], *[F.col(c).alias(f"x{k}") for k, c in enumerate(extra)],
    )
    kinds = {f.name: f.dataType for f in held.schema.fields}
    key = F.xxhash64("text")
    rows = keep(held.select(
        "id", key.alias("key"), (F.shiftrightunsigned(key, 12).cast("double") / F.lit(float(1 << 52))).alias("hash"),
        (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        *[_coordinate(F.col(f"d{k}"), kinds[f"d{k}"]).alias(f"d{k}") for k in range(len(dims))], *[f"x{k}" for k in range(len(extra))],
        F.monotonically_increasing_id().alias("row"),
    ))
    names = [f"d{k}" for k in range(len(dims))]
    # Missing coordinates count as the smallest ones there are.
    least = rows.agg(*[F.coalesce(F.min(c), F.lit(0.0)).alias(c) for c in names]).first()
    rows = rows.fillna({c: least[c] for c in names})
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), *[f(c).alias(f"{n}_{c}") for c in names for n, f in (("low", F.min), ("high", F.max))])
    differ = " or ".join(f"low_{c} < high_{c}" for c in names)
    mixed = keep(groups.where(differ).select("key", "copies", *[f"low_{c}" for c in names]))
    small = bounded(mixed)
    joined = lookup_join(rows, mixed, ["key"], "copies", "left") if small is mixed else rows.join(small, "key", "left")
    return joined.select(*[F.coalesce(f"low_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns])


def shard(
    docs: DataFrame, dims: Mapping[str, Column] | list[str], *, shards: int | None = None, target_bytes: int | None = None, id: str = "doc_id",
    text: str = "text", extra: list[str] = (), whole: float = WHOLE, bins: int = BINS, block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (bytes of the text and one more), ``text_crc32``, ``shard``, ``slot`` and the ``extra`` columns.

    ``dims`` names the metadata columns, or gives expressions: numbers, dates, booleans or texts. There are ``shards`` leaves, or as many as bring their
    bytes to ``target_bytes``. Their sizes differ by about the size of a document, or by ``whole`` of a shard where a cut goes round a group of
    equal texts. ``slot`` numbers a shard's rows from 0 without gaps. Null texts are like empty ones; nulls and NaN in a dimension count as its smallest
    value; repeated rows are separate points that may be parted. With fewer documents than shards some shards are empty; an empty table gives an
    empty one. Columns other than those named are not read, and ``extra`` may have any names but those of the result.
    """
    extra = list(extra)
    if (shards is None) == (target_bytes is None) or (shards or target_bytes) < 1:
        raise ValueError("either a number of shards or a target size")
    found = points(docs, dims, id=id, text=text, extra=extra)
    total = found.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    tree = _Tree(found, len(dims), shards, whole * total / shards, bins)
    if total:
        tree.grow()
    rows = tree.placed.select("id", "size", "text_crc32", F.col("node").alias("shard"), "row", *[f"x{k}" for k in range(len(extra))])
    block = F.shiftright("row", block_bits).alias("block")
    counts = rows.groupBy("shard", block).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = bounded(keep(counts.select("shard", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")) - 1
    numbered = rows.withColumn("block", block).withColumn("inside", inside).join(offsets, ["shard", "block"])
    return numbered.select(
        F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"),
        *[F.col(f"x{k}").alias(c) for k, c in enumerate(extra)],
    )


def write(placed: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """The rows of ``shard`` as Parquet, a folder for each shard, in the order of their slots; a file holds up to ``rows_per_file`` rows."""
    part = F.floor(F.col("slot") / rows_per_file)
    rows = placed.withColumn("__file__", part).repartition("shard", "__file__").sortWithinPartitions("shard", "slot").drop("__file__")
    rows.write.partitionBy("shard").parquet(path)
