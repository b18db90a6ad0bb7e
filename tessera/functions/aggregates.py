"""Aggregates by name: each builds a column from its input column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import int_div

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": lambda c: F.count(F.lit(1)),  # rows of the group, whatever the input
    "min": F.min,
    "max": F.max,
    "bit_or": F.bit_or,
    "any": lambda c: F.max(c.cast("int")),
    "copy": F.first,
    "avg_int": lambda c: int_div(F.sum(c), F.count(c)),
    "count_distinct": F.count_distinct,
    "sum_squares": lambda c: F.sum(c * c),
}


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    """Adds an aggregate of your own: a function from the input column to an aggregate column.

    It may also wrap a ``pandas_udf`` of the grouped-aggregate kind.
    """
    if name in AGGREGATES:
        raise ValueError(f"aggregate {name} exists")
    AGGREGATES[name] = build


def aggregate_column(name: str, column: str | None) -> Column:
    if name not in AGGREGATES:
        raise KeyError(f"unknown aggregate {name}; known: {', '.join(sorted(AGGREGATES))}")
    return AGGREGATES[name](F.lit(1) if column is None else F.col(column))
