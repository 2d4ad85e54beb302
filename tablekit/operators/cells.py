"""Finding, reading and changing cells and rows by position, many addresses at a time.

``index`` names the dense row index. Address tables are joined on it: broadcast when they are counted to be small, so
that the table itself is not shuffled, else by an ordinary join on the index, which is unique and cannot be skewed.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..errors import ColumnNotFound, InvalidParameter
from ..functions.text import check_regex
from ..plans.columns import INDEX, data_columns, equals, missing, ref, require, type_of, value_of
from ..plans.joins import bounded
from ..plans.positions import rows_between, rows_known, runs_of
from ..plans.order import renumber

CellValue = str | int | float | bool | None


def find_cells_with_value(
    df: DataFrame, value: CellValue, columns: Sequence[str] | None = None, exact_match: bool = True,
    index: str = INDEX,
) -> DataFrame:
    """(row index, column, value as text) of every matching cell, from one scan without a shuffle.

    ``None`` finds missing cells. ``exact_match=False`` with text searches for a case-insensitive regular expression.
    """
    require(df, [index])
    names = data_columns(df, columns, index)
    hits = {}
    for name in names:
        if value is None:
            hits[name] = missing(df, name)
        elif not exact_match and isinstance(value, str):
            hits[name] = value_of(df, name).cast("string").rlike("(?i)" + check_regex(df.sparkSession, value))
        else:
            hits[name] = equals(df, name, value)
    hits = {name: hit for name, hit in hits.items() if hit is not None}
    if not hits:
        return df.sparkSession.createDataFrame([], f"`{index}` bigint, column string, value string")
    cells = [
        F.when(hit, F.struct(F.lit(name).alias("column"), value_of(df, name).cast("string").alias("value")))
        for name, hit in hits.items()
    ]
    found = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return df.select(F.col(index), F.explode(found).alias("x")).select(index, "x.column", "x.value")


def _column_window(df: DataFrame, column: str | int, radius: int, index: str) -> list[str]:
    names = [c for c in df.columns if c != index]
    if isinstance(column, int):
        if not 0 <= column < len(names):
            raise InvalidParameter("column", column, f"0 to {len(names) - 1}")
        at = column
    else:
        if column not in names:
            raise ColumnNotFound(column, names)
        at = names.index(column)
    return names[max(0, at - radius) : at + radius + 1]


def inspect_data_around(df: DataFrame, row: int, column: str | int, radius: int = 2, index: str = INDEX) -> DataFrame:
    """The rows ``row - radius .. row + radius`` and the columns around ``column``; pushed into the scan."""
    names = _column_window(df, column, radius, index)
    return rows_between(df, [(row - radius, row + radius)], index).select(index, *[ref(c) for c in names])


def inspect_data_around_many(
    df: DataFrame, centres: DataFrame, column: str | int, radius: int = 2, index: str = INDEX
) -> DataFrame:
    """The same for many rows: ``centres`` has a column ``centre``. Every centre becomes 2r + 1 addresses."""
    names = _column_window(df, column, radius, index)
    wanted = centres.select(
        "centre", F.explode(F.sequence(F.col("centre") - radius, F.col("centre") + radius)).alias(index)
    )
    return bounded(wanted).join(df.select(index, *[ref(c) for c in names]), index).select("centre", index, *[ref(c) for c in names])


def _named(df: DataFrame, addresses: DataFrame, index: str) -> DataFrame:
    """Addresses with column names; 0-based column numbers are translated, a number without a column is kept as text."""
    require(addresses, [index, "column"])
    if not isinstance(type_of(addresses, "column"), T.IntegralType):
        return addresses
    names = F.array(*[F.lit(c) for c in df.columns if c != index])
    number = F.col("column").cast("int")
    return addresses.withColumn("column", F.coalesce(F.get(names, number), number.cast("string")))


def lookup_cells(df: DataFrame, addresses: DataFrame, index: str = INDEX) -> DataFrame:
    """(row index, column, value as text, type) for ``addresses`` (row index, column); bad addresses are left out."""
    addresses = _named(df, addresses, index)
    names = data_columns(df, None, index)
    value, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in names:
        hit = F.col("__column__") == F.lit(name)
        value = F.when(hit, value_of(df, name).cast("string")).otherwise(value)
        kind = F.when(hit, F.lit(type_of(df, name).simpleString())).otherwise(kind)
    wanted = addresses.select(F.col(index), F.col("column").alias("__column__")).filter(F.col("__column__").isin(names))
    joined = bounded(wanted).join(df, index)
    return joined.select(index, F.col("__column__").alias("column"), value.alias("value"), kind.alias("type"))


def lookup_rows(df: DataFrame, rows: Iterable[int] | DataFrame, columns: Sequence[str] | None = None, index: str = INDEX) -> DataFrame:
    names = data_columns(df, columns, index)
    if isinstance(rows, DataFrame):
        return df.select(index, *[ref(c) for c in names]).join(bounded(rows.select(index)), index, "left_semi")
    return rows_between(df, runs_of(list(rows)), index).select(index, *[ref(c) for c in names])


def column_slice(df: DataFrame, column: str, start: int = 0, end: int | None = None, index: str = INDEX) -> DataFrame:
    """The values of one column for ``start <= row < end``."""
    require(df, [index, column])
    if start < 0:
        raise InvalidParameter("start", start, "0 or more")
    if end is not None and end <= start:
        raise InvalidParameter("end", end, f"more than the start, {start}")
    known = rows_known(df, index)
    if start and (start >= known if known is not None else df.filter(F.col(index) >= start).isEmpty()):
        raise InvalidParameter("start", start, "a row of the table")
    return rows_between(df, [(start, (1 << 62) if end is None else end - 1)], index).select(index, ref(column))


def patch_cells(df: DataFrame, patches: DataFrame, index: str = INDEX) -> DataFrame:
    """Set many cells: ``patches`` holds (row index, column, value as text) and optionally ``seq`` (highest wins).

    Text that does not parse as the column's type becomes null. Rows without a patch are unchanged.
    """
    wide, names = _wide_patches(df, patches, index)
    joined = df.join(bounded(wide), index, "left")
    return joined.select(*[
        F.when(F.col(f"__p{names.index(c)}__").isNotNull(), F.col(f"__p{names.index(c)}__.value").try_cast(type_of(df, c)))
        .otherwise(ref(c)).alias(c) if c in names else ref(c) for c in df.columns
    ])


def _wide_patches(df, patches, index):
    """One row per patched row, one struct per column that is patched (null: keep)."""
    require(df, [index])
    require(patches, [index, "column", "value"])
    patches = _named(df, patches, index)
    names = [c for c in df.columns if c != index]
    seq = F.col("seq") if "seq" in patches.columns else F.lit(0)
    picked = [
        F.max_by(F.struct(F.col("value").cast("string").alias("value")), F.when(F.col("column") == name, seq)).alias(f"__p{i}__")
        for i, name in enumerate(names)
    ]
    return patches.filter(F.col("column").isin(names)).groupBy(index).agg(*picked), names


def patch_report(df: DataFrame, patches: DataFrame, index: str = INDEX) -> DataFrame:
    """(row index, column, old value, new value) of the cells that ``patch_cells`` sets."""
    wide, names = _wide_patches(df, patches, index)
    joined = bounded(wide).join(df, index)
    cells = [
        F.when(F.col(f"__p{i}__").isNotNull(), F.struct(
            F.lit(c).alias("column"), value_of(df, c).cast("string").alias("old_value"),
            F.col(f"__p{i}__.value").try_cast(type_of(df, c)).cast("string").alias("new_value"),
        )) for i, c in enumerate(names)
    ]
    found = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return joined.select(F.col(index), F.explode(found).alias("x")).select(index, "x.*")


def insert_rows(df: DataFrame, new_rows: DataFrame, at: int = -1, index: str = INDEX) -> DataFrame:
    """Insert rows before position ``at`` (-1: at the end). Columns that ``new_rows`` lacks become null.

    ``new_rows`` carries its own order in ``index``. Only the index of later rows changes, so nothing is shuffled.
    """
    require(df, [index])
    require(new_rows, [index])
    for c in new_rows.columns:
        if c not in df.columns:
            raise ColumnNotFound(c, df.columns)
    size = df.agg(F.coalesce(F.max(index) + 1, F.lit(0))).first()[0]
    position = size if at == -1 else at
    if not 0 <= position <= size:
        raise InvalidParameter("at", at, f"-1 or 0 to {size}")
    added = renumber(new_rows, by=index, index=index)
    shifted = F.when(F.col(index) >= position, F.col(index) + F.lit(new_rows.count())).otherwise(F.col(index))
    given = [c for c in df.columns if c in new_rows.columns and c != index]
    added = added.select(
        (F.col(index) + F.lit(position)).alias(index),
        *[ref(c).try_cast(type_of(df, c)).alias(c) if c in given else F.lit(None).cast(type_of(df, c)).alias(c)
          for c in df.columns if c != index],
    )
    return df.withColumn(index, shifted.cast("long")).unionByName(added)


def rows_from_json(json_rows: DataFrame, like: DataFrame, index: str = INDEX) -> DataFrame:
    """Rows for ``insert_rows`` from a table (row index, json) of objects; missing keys give null."""
    schema = T.StructType([f for f in like.schema.fields if f.name != index])
    return json_rows.select(F.col(index), F.from_json("json", schema).alias("x")).select(index, "x.*")


def delete_rows(df: DataFrame, rows: Iterable[int] | DataFrame, index: str = INDEX) -> DataFrame:
    """Remove rows by position and close the gaps.

    A list shifts the later rows by a literal count, without a shuffle; a DataFrame of positions is anti-joined. Positions
    outside the table raise.
    """
    require(df, [index])
    size = df.agg(F.coalesce(F.max(index) + 1, F.lit(0))).first()[0]
    if isinstance(rows, DataFrame):
        low, high = rows.agg(F.min(index), F.max(index)).first()
        if low is not None and not 0 <= low <= high < size:
            raise InvalidParameter("rows", low if low < 0 else high, f"0 to {size - 1}")
        return renumber(df.join(bounded(rows.select(index)), index, "left_anti"), by=index, index=index)
    gone = sorted(set(rows))
    if not gone:
        return df
    if gone[0] < 0 or gone[-1] >= size:
        raise InvalidParameter("rows", gone[0] if gone[0] < 0 else gone[-1], f"0 to {size - 1}")
    before = F.size(F.filter(F.array(*[F.lit(r).cast("long") for r in gone]), lambda r: r < F.col(index)))
    return df.filter(~F.col(index).isin(gone)).withColumn(index, (F.col(index) - before).cast("long"))


def bad_addresses(df: DataFrame, addresses: DataFrame, index: str = INDEX) -> DataFrame:
    """The addresses (row index, column) outside the table, with a reason."""
    addresses = _named(df, addresses, index)
    names = [c for c in df.columns if c != index]
    size = df.agg(F.coalesce(F.max(index) + 1, F.lit(0)).alias("n")).scalar()
    row_bad = (F.col(index) < 0) | (F.col(index) >= size)
    column_bad = ~F.col("column").isin(names)
    reason = F.when(row_bad, F.lit("row out of range")).when(column_bad, F.lit("column not found"))
    return addresses.select(F.col(index), F.col("column"), reason.alias("reason")).filter("reason IS NOT NULL")

