"""Errors raised while a plan is being built, before any Spark job runs."""

from __future__ import annotations

from collections.abc import Iterable


class TablekitError(ValueError):
    """Base of every error raised by this package."""


class ColumnNotFound(TablekitError):
    def __init__(self, column: object, available: Iterable[str]):
        self.column = column
        self.available = list(available)
        super().__init__(f"column {column!r} not found; the table has {self.available}")


class InvalidParameter(TablekitError):
    def __init__(self, name: str, value: object, expected: str):
        self.name = name
        self.value = value
        super().__init__(f"invalid {name}={value!r}: expected {expected}")


class EmptyInput(TablekitError):
    """A source held no usable rows."""
