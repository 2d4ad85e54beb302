"""Rows of files by position: only files that hold wanted positions are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .columns import ref

#: More files than this are filtered by the row index alone.
NAMED_FILES = 1000
_LAYOUT = "_tablekit_layout"


@dataclass(frozen=True)
class Layout:
    """Files in order, each with its path, the rows before it and its own rows; ``scan`` reads them."""

    scan: DataFrame
    files: Sequence[tuple[str, int, int]]
    index: str


def remember(df: DataFrame, layout: Layout) -> DataFrame:
    """``df``, which numbers the rows of ``layout``; what is derived from it forgets that."""
    setattr(df, _LAYOUT, layout)
    return df


def rows_between(df: DataFrame, ranges: Sequence[tuple[int, int]], index: str) -> DataFrame:
    """The rows whose index lies in one of the ``ranges``, ends included.

    Where ``df`` numbers the rows of files, the wanted files are named to the scan, which doesn't open the others.
    """
    layout = vars(df).get(_LAYOUT)
    if layout is None or layout.index != index:
        return df.filter(_any(F.col(index), ranges))
    chosen = [(path, before) for path, before, n in layout.files if any(lo < before + n and hi >= before for lo, hi in ranges)]
    if len(chosen) > NAMED_FILES:
        return df.filter(_any(F.col(index), ranges))
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    place = F.lit(None).cast("long")
    for name, before in chosen:
        place = F.when(path == name, row + F.lit(before)).otherwise(place)
    held = layout.scan.filter(path.isin([name for name, _ in chosen]) if chosen else F.lit(False))
    numbered = held.select(place.alias(index), *[ref(c) for c in layout.scan.columns])
    return numbered.filter(_any(F.col(index), ranges))


def _any(position, ranges):
    found = F.lit(False)
    for lo, hi in ranges:
        found = found | position.between(lo, hi)
    return found


def rows_known(df: DataFrame, index: str) -> int | None:
    """The number of rows, if the files tell it."""
    layout = vars(df).get(_LAYOUT)
    return None if layout is None or layout.index != index else sum(n for _, _, n in layout.files)


def runs_of(rows: Sequence[int]) -> list[tuple[int, int]]:
    """Ranges of consecutive integers."""
    out: list[list[int]] = []
    for r in sorted(set(rows)):
        if out and r == out[-1][1] + 1:
            out[-1][1] = r
        else:
            out.append([r, r])
    return [(a, b) for a, b in out]
