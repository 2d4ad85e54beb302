"""Reading delimited text and Parquet, with row numbers in file order, and bounded previews."""

from __future__ import annotations

import csv
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..errors import EmptyInput, InvalidParameter
from ..functions.casts import NUMBER, SPECIAL
from ..plans.columns import INDEX, ref
from ..plans.joins import bounded
from ..plans.positions import Layout, remember, rows_between, rows_known
from ..plans.store import keep

# The texts that are read as null.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
# The spellings of booleans; a column is boolean when it holds nothing else.
BOOLEANS = ("true", "false", "True", "False", "TRUE", "FALSE")
# What a record has beyond the columns.
SURPLUS = "__surplus__"
# File offsets are broadcast up to this many files; above, they are joined like any other table.
BROADCAST_FILES = 100_000


def read_csv(
    spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", header: str = "auto", header_row: int = 0,
    encoding: str = "UTF-8", infer_types: bool = True, row_index: bool = True, max_rows: int | None = None,
) -> DataFrame:
    """Delimited text as a typed table.

    ``header``: ``auto`` (first line names the columns), ``none`` (``Column_0``, ``Column_1``, ...) or ``row`` (record
    ``header_row`` names them and those before it are skipped, in every file). The header, or the first record, also gives the
    number of columns, whatever stands above it: a record with fewer fields is filled up with nulls, one with more raises.
    Names that repeat get ``.1``, ``.2``, ... All values are read as text, the usual spellings of "missing" become null, and
    one aggregate decides boolean, integer, double or text per column.

    Files are split between tasks. Where quotes hold line breaks, or the encoding's line break is wider than a byte, lines are read as such
    and put together to records (``_records``). Only files with bare carriage returns beside such breaks, or with wide characters that look
    like a line break out of step, are read by one task each.
    """
    if header not in ("auto", "none", "row"):
        raise InvalidParameter("header", header, "auto, none or row")
    if header_row < 0:
        raise InvalidParameter("header_row", header_row, "0 or more")
    paths = [path] if isinstance(path, str) else list(path)
    lines = _Lines(spark, paths, encoding)
    way = _way(lines, delimiter)
    first = _record(lines, delimiter, header_row if header == "row" else 0)
    names = [f"__c{i}__" for i in range(len(first))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])
    options = dict(sep=delimiter, quote='"', escape='"', mode="PERMISSIVE", nullValue="\0")
    skipped = {"auto": 1, "none": 0, "row": header_row + 1}[header]
    numbered = row_index or header == "row" or way == "records"
    if way == "records":
        raw = _positions(keep(_records(lines, delimiter, schema, options)))
    else:
        raw = spark.read.schema(schema).options(**options, header=header == "auto", encoding=encoding, multiLine=way == "whole").csv(paths)
        skipped -= header == "auto"
    if numbered and way != "records":
        # splits depend on the cluster's size, so the position is fixed by writing it; text is parsed only once
        raw = keep(raw.select(
            *raw.columns, F.col("_metadata.file_path").alias("__file__"),
            F.col("_metadata.file_block_start").alias("__start__"),
            F.monotonically_increasing_id().alias("__at__"),
        ))
        raw = _positions(raw)
    if header == "none":
        renamed = [f"Column_{i}" for i in range(len(names))]
    else:
        renamed = _distinct([n or f"Column_{i}" for i, n in enumerate(first)])
    if skipped:
        raw = raw.filter(F.col("__in_file__") >= skipped)
        raw = raw.withColumn(INDEX, F.col(INDEX) - (F.col("__file_no__") + 1) * skipped)
    long = raw.filter(F.col(SURPLUS).isNotNull()).count()
    if long:
        raise InvalidParameter("path", paths, f"at most {len(names)} fields in a record; {long} records have more")
    text = raw.select(
        *([F.col(INDEX)] if numbered and row_index else []),
        *[F.when(~F.trim(ref(old)).isin(list(NA_TOKENS)), ref(old)).alias(new) for old, new in zip(names, renamed)],
    )
    if not text.take(1):
        raise EmptyInput(f"no rows in {paths}")
    if max_rows is not None and text.limit(max_rows + 1).count() > max_rows:
        raise InvalidParameter("max_rows", max_rows, "at least the number of rows in the files")
    return infer_column_types(text, renamed) if infer_types else text


class _Lines:
    """The lines of files, decoded. The source cuts bytes at the encoding's line feed, so that files of any encoding can be split."""

    def __init__(self, spark: SparkSession, paths: Sequence[str], encoding: str):
        self.spark, self.paths = spark, list(paths)
        self.name = encoding.upper().replace("_", "-")
        self.unit = 2 if self.name.startswith("UTF-16") else 4 if self.name.startswith("UTF-32") else 1
        self.little = self.name.endswith("LE") or (self.unit > 1 and not self.name.endswith("BE") and self._mark() == b"\xff\xfe")
        self.separator = "\n" if self.unit == 1 else "\n" + "\0" * (self.unit - 1) if self.little else "\0" * (self.unit - 1) + "\n"

    def _mark(self) -> bytes:
        head = self.spark.read.text(self.files()[:1]).select(F.substring(F.col("value").cast("binary"), 1, 2)).first()
        return bytes(head[0]) if head else b""

    def files(self) -> list[str]:
        return sorted(self.spark.read.text(self.paths).inputFiles())

    def read(self, paths: Sequence[str] | None = None) -> DataFrame:
        """``value`` as text, and ``__bytes__``, its length in the file."""
        rows = self.spark.read.options(lineSep=self.separator).text(list(paths or self.paths))
        value = F.col("value").cast("binary")
        if self.unit == 2:
            text = F.decode(value, "UTF-16LE" if self.little else "UTF-16BE")
        elif self.unit == 4:
            text = F.decode(F.concat(F.lit(b"\xff\xfe\0\0" if self.little else b"\0\0\xfe\xff"), value), "UTF-32")
        else:
            text = F.col("value") if self.name in ("UTF-8", "UTF8") else F.decode(value, self.name)
        if self.unit > 1:  # out of step: null
            text = F.when(F.octet_length(value) % self.unit == 0, text)
        return rows.withColumns({"__bytes__": F.octet_length(value), "value": F.regexp_replace(text, "^\ufeff", "")})


def _ends_inside(delimiter: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes: if it begins outside, and if it begins inside. Doubled quotes change nothing and are left out."""
    d = "\\" + delimiter if delimiter not in "\t" else delimiter
    inside = r'[^"]*+'
    field = rf'(?:"{inside}"[^{d}]*+|[^"{d}][^{d}]*+)?'
    opened = rf'(?:{field}{d})*+"{inside}\z'
    line = F.replace("value", F.lit('""'), F.lit(""))
    return line.rlike(rf"^{opened}"), line.rlike(rf'^{inside}(?:\z|"[^{d}]*+{d}{opened})')


def _way(lines: _Lines, delimiter: str) -> str:
    """``plain``: every line is a record. ``records``: lines have to be put together. ``whole``: each file has to be read by one task."""
    opened, _ = _ends_inside(delimiter)
    found = lines.read().agg(
        F.bool_or(opened).alias("opened"), F.bool_or(F.col("value").rlike(r"\r(?!\z)")).alias("returns"),
        F.bool_or(F.col("__bytes__") % lines.unit != 0).alias("astray"),
    ).first()
    if found["returns"] and lines.unit == 1:  # also a line break of its own
        ended = lines.spark.read.text(lines.paths)
        return "plain" if ended.filter(opened).isEmpty() else "whole"
    if found["returns"] or found["astray"]:
        return "whole"
    return "records" if found["opened"] or lines.unit > 1 else "plain"


def _state(start: Column, constant: Column, flips: Column) -> Column:
    """1 inside quotes, 0 outside, from what the latest line that doesn't depend on its beginning leaves, and the lines since that change sides."""
    known = F.when(constant.isNull(), start + flips).otherwise(constant["ends"] + flips - constant["flips"])
    return F.pmod(known, F.lit(2))


def _records(lines: _Lines, delimiter: str, schema: T.StructType, options: dict) -> DataFrame:
    """Parsed records with their file, split and number in the split.

    Whether a line begins inside quotes is a prefix scan: each line maps the two states to two states, a split's lines are composed by
    windows inside the split, splits are composed by one row each, and the state at a split's beginning goes back to its lines. Lines that go on
    with a record of an earlier split are joined to it. Splits bound what a window or a record's list holds, but for a record that is longer itself.
    """
    split = ["__file__", "__start__"]
    kept = keep(lines.read().select(
        "value", F.col("_metadata.file_path").alias("__file__"), F.col("_metadata.file_block_start").alias("__start__"), F.monotonically_increasing_id().alias("__at__"),
    ))
    inner = Window.partitionBy(*split).orderBy("__at__")
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    ends = _ends_inside(delimiter)
    rows = kept.withColumns({"__from_out__": ends[0].cast("int"), "__from_in__": ends[1].cast("int")})
    flip = ((F.col("__from_out__") == 1) & (F.col("__from_in__") == 0)).cast("int")
    rows = rows.withColumn("__flips__", F.coalesce(F.sum(flip).over(earlier), F.lit(0)))
    settled = F.when(F.col("__from_out__") == F.col("__from_in__"), F.struct(F.col("__from_out__").alias("ends"), F.col("__flips__").alias("flips")))
    rows = rows.withColumn("__settled__", F.last(settled, True).over(earlier))
    # One row per split: what it does to the state, and from that the state at its beginning.
    sums = rows.groupBy(*split).agg(F.sum(flip).alias("flips"), F.max_by(settled, F.when(settled.isNotNull(), F.col("__at__"))).alias("settled"))
    ordered = Window.partitionBy("__file__").orderBy("__start__").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.when(F.col("settled").isNull(), F.col("flips")).otherwise(F.lit(0))
    sums = sums.withColumn("before", F.coalesce(F.sum(turned).over(ordered), F.lit(0)))
    left = F.when(F.col("settled").isNotNull(), F.struct(_state(F.lit(0), F.col("settled"), F.col("flips")).alias("ends"), F.col("before").alias("flips")))
    sums = sums.withColumn("last", F.last(left, True).over(ordered))
    begins = keep(sums.select(*split, _state(F.lit(0), F.col("last"), F.col("before")).alias("__begins__")))
    placed = rows.join(bounded(begins), split)
    inside = _state(F.col("__begins__"), F.col("__settled__"), F.col("__flips__"))
    placed = placed.select(*split, "__at__", "value", F.last(F.when(inside == 0, F.col("__at__")), True).over(inner).alias("__record__"))
    collected = F.array_sort(F.collect_list(F.struct("__at__", "value")))
    body = placed.where("__record__ is not null").groupBy(*split, "__record__").agg(collected.alias("__lines__"))
    # Lines at a split's beginning that go on with the last record of an earlier one.
    latest = placed.groupBy(*split).agg(F.max("__record__").alias("latest"), F.min("__record__").alias("first"), F.min("__at__").alias("at"))
    owner = latest.withColumn("__record__", F.last("latest", True).over(ordered)).where("first is null or at < first").select(*split, "__record__")
    heads = placed.where("__record__ is null").drop("__record__").join(F.broadcast(owner), split)
    heads = keep(heads.groupBy("__file__", "__record__").agg(collected.alias("__more__")))
    whole = body.join(bounded(heads), ["__file__", "__record__"], "left")
    both = F.concat("__lines__", F.coalesce("__more__", F.array().cast("array<struct<__at__:bigint,value:string>>")))
    text = F.regexp_replace(F.array_join(F.transform(both, lambda x: x["value"]), "\n"), "\r\\z", "")
    named = whole.select(*split, "__record__", text.alias("__text__")).where(F.col("__text__").rlike(r"[^\x00-\x20]"))
    number = F.row_number().over(Window.partitionBy(*split).orderBy("__record__")) - 1
    parsed = F.from_csv("__text__", schema.simpleString()[7:-1].replace(":", " "), {**options, "multiLine": "true"})
    return named.select(*split, number.cast("long").alias("__at__"), parsed.alias("__row__")).select("__row__.*", *split, "__at__")


def _record(lines: _Lines, delimiter: str, number: int) -> list[str]:
    """The fields of a record of the first file by path. Lines without any character don't count."""
    files, many = lines.files(), number + 100
    while files:
        found = [(r["value"] or "").removesuffix("\r") for r in lines.read(files[:1]).limit(many).collect()]
        if len(found) == 1 and "\r" in found[0]:
            found = found[0].split("\r")
        reader = csv.reader([x + "\n" for x in found], delimiter=delimiter)
        records = list(itertools.islice((r for r in reader if r), number + 1))
        # The last line's record may go on in lines that weren't read.
        if len(records) > number and (reader.line_num < len(found) or len(found) < many):
            return records[number]
        if len(found) < many:
            break
        many *= 2
    raise EmptyInput(f"no line {number} in {lines.paths}")


def _distinct(names: Sequence[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        new, k = name, 0
        while new in out or (k and new in names):
            k += 1
            new = f"{name}.{k}"
        out.append(new)
    return out


def infer_column_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast text columns to boolean, long or double where every value fits, decided by one aggregate."""
    def fits(c, kind):
        v = F.trim(ref(c))
        good = {
            "boolean": lambda: v.isin(list(BOOLEANS)),
            "bigint": lambda: F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint").isNotNull()).otherwise(F.lit(False)),
            "double": lambda: v.rlike(NUMBER) | v.rlike(SPECIAL),
        }[kind]()
        return F.bool_and(v.isNull() | good)

    kinds = ("boolean", "bigint", "double")
    row = df.agg(*[
        F.struct(F.count(ref(c)), *[fits(c, kind) for kind in kinds]).alias(f"k{i}") for i, c in enumerate(columns)
    ]).first()
    casts = {}
    for i, c in enumerate(columns):
        known, *ok = row[f"k{i}"]
        kind = next((k for k, good in zip(kinds, ok) if good), None) if known else None
        if kind:
            casts[c] = F.trim(ref(c)).try_cast(kind)
    return df.withColumns(casts) if casts else df


def _positions(raw: DataFrame) -> DataFrame:
    """Row index over all files in path order, and the position inside each file.

    A file split is read by one task in order, so the position is the offset of the split plus the rows before it.
    One offset per split is computed on the driver, which already lists the splits when it plans the scan.
    """
    spark = raw.sparkSession
    splits = raw.groupBy("__file__", "__start__").agg(
        F.count(F.lit(1)).alias("n"), F.min("__at__").alias("first")
    ).collect()
    offsets, total, in_file, file_no, previous = [], 0, 0, -1, None
    for s in sorted(splits, key=lambda r: (r["__file__"], r["__start__"])):
        if s["__file__"] != previous:
            previous, in_file, file_no = s["__file__"], 0, file_no + 1
        offsets.append((s["__file__"], s["__start__"], total - s["first"], in_file - s["first"], file_no))
        total, in_file = total + s["n"], in_file + s["n"]
    table = spark.createDataFrame(
        offsets, "__file__ string, __start__ bigint, __all__ bigint, __mine__ bigint, __file_no__ bigint"
    )
    joined = raw.join(_bounded(table, len(offsets)), ["__file__", "__start__"])
    return joined.withColumns({
        INDEX: F.col("__at__") + F.col("__all__"), "__in_file__": F.col("__at__") + F.col("__mine__"),
    })


def _bounded(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_FILES else table


def read_parquet(spark: SparkSession, path: str | Sequence[str], row_index: bool = True, index: str = INDEX) -> DataFrame:
    """Parquet files with the row index in path order.

    The format knows each row's position in its file, so the index is that position plus the rows of earlier files:
    no shuffle, nothing written, and the same answer when a task runs again. Counting the files reads only footers.
    """
    scan = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if not row_index:
        return scan
    in_file = F.col("_metadata.row_index")
    counts = scan.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, files, total = [], [], 0
    for r in sorted(counts, key=lambda r: r["f"]):
        offsets.append((r["f"], total))
        files.append((r["f"], total, r["n"]))
        total += r["n"]
    layout = Layout(scan, files, index)
    if len(counts) <= 1:
        return remember(scan.select(in_file.alias(index), *[ref(c) for c in scan.columns]), layout)
    table = spark.createDataFrame(offsets, "__file__ string, __offset__ bigint")
    rows = scan.select(F.col("_metadata.file_path").alias("__file__"), in_file.alias("__row__"), *[ref(c) for c in scan.columns])
    joined = rows.join(_bounded(table, len(offsets)), "__file__")
    return remember(joined.select((F.col("__row__") + F.col("__offset__")).alias(index), *[ref(c) for c in scan.columns]), layout)


def preview(df: DataFrame, rows: int = 5, index: str = INDEX) -> DataFrame:
    """The first rows by position, with the table's shape and whether there is more. Values stay typed."""
    if rows < 0:
        raise InvalidParameter("rows", rows, "0 or more")
    known = rows_known(df, index)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar() if known is None else F.lit(known).cast("long")
    return rows_between(df, [(0, rows - 1)], index).withColumns({
        "total_rows": total, "total_columns": F.lit(len(df.columns) - 1).cast("long"), "truncated": total > F.lit(rows),
    })


def parse_csv_column(df: DataFrame, column: str, schema: T.StructType | str, delimiter: str = ",") -> DataFrame:
    """Delimited lines that are already in a table's column, parsed by position."""
    return df.withColumn("__csv__", F.from_csv(ref(column), schema if isinstance(schema, str) else schema.simpleString()[7:-1],
                                                {"sep": delimiter})).select(*[ref(c) for c in df.columns if c != column], "__csv__.*")
