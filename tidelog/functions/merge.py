"""Merge operators: ordered folds of operands onto a base value, as column expressions.

An operator is a name and a fold.  `fold(base, operands)` gets the base value (null without one) and the operands'
values, oldest first, as an array of binaries.  `Associative` operators also say how operands combine in any grouping,
so that a key with very many operands is summed by partial aggregation and never gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import InvalidArgument


@dataclass(frozen=True)
class MergeOperator:
    name: str
    fold: Callable[[Column, Column], Column]
    #: Aggregates operand values (given as a column) and joins the aggregate with the base; None if order matters.
    combine: Callable[[Column], Column] | None = None
    finish: Callable[[Column, Column], Column] | None = None


def string_append(delimiter: bytes = b",") -> MergeOperator:
    """Operands joined to what is there; the delimiter is only put behind something non-empty."""
    joint = F.lit(bytearray(delimiter))

    def fold(base: Column, operands: Column) -> Column:
        start = F.coalesce(base, F.lit(bytearray(b"")))
        return F.aggregate(operands, start, lambda acc, x: F.when(F.octet_length(acc) == 0, x).otherwise(F.concat(acc, joint, x)))

    return MergeOperator("string_append", fold)


def newest() -> MergeOperator:
    """What a keyspace without an operator shows: the newest operand as it is."""
    return MergeOperator("newest", lambda base, operands: F.element_at(operands, -1))


def _decimal(data: Column) -> Column:
    return data.cast("string").cast("long")


def counter() -> MergeOperator:
    """Sums of decimal numbers."""
    as_bytes = lambda c: c.cast("string").cast("binary")

    def fold(base: Column, operands: Column) -> Column:
        return as_bytes(F.aggregate(operands, F.coalesce(_decimal(base), F.lit(0).cast("long")), lambda acc, x: acc + _decimal(x)))

    return MergeOperator(
        "counter", fold, combine=lambda value: F.sum(_decimal(value)), finish=lambda base, total: as_bytes(F.coalesce(_decimal(base), F.lit(0)) + total)
    )


def maximum() -> MergeOperator:
    """The largest operand in byte order."""
    return MergeOperator(
        "max",
        lambda base, operands: F.greatest(F.coalesce(base, F.array_max(operands)), F.array_max(operands)),
        combine=lambda value: F.max(value),
        finish=lambda base, top: F.greatest(F.coalesce(base, top), top),
    )


_registry: dict[str, Callable[..., MergeOperator]] = {"string_append": string_append, "newest": newest, "counter": counter, "max": maximum}


def register(name: str, factory: Callable[..., MergeOperator]) -> None:
    _registry[name] = factory


def operator(name: str, **options) -> MergeOperator:
    """A registered operator; unknown names are an error."""
    if name not in _registry:
        raise InvalidArgument(f"no merge operator is named {name!r}")
    return _registry[name](**options)
