"""Bounds and orders over byte-string keys, computed on the driver for use in pushed-down filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_successor(prefix: bytes) -> bytes | None:
    """The smallest key above every key that starts with `prefix`; None if there is none (empty or all 0xff)."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short key k with start <= k < limit; `start` itself where no shorter one is found."""
    at = common_prefix(start, limit)
    if at == min(len(start), len(limit)) or start[at] == 0xFF or start[at] + 1 >= limit[at]:
        return start
    return start[:at] + bytes([start[at] + 1])


def short_successor(key: bytes) -> bytes:
    """A short key at or above `key`: its first byte below 0xff, raised by one; `key` if all are 0xff."""
    at = next((i for i, b in enumerate(key) if b != 0xFF), None)
    return key if at is None else key[:at] + bytes([key[at] + 1])


def common_prefix(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def binary(value: bytes) -> Column:
    return F.lit(bytearray(value))


def in_range(key: Column, lower: bytes | None = None, upper: bytes | None = None) -> Column:
    """lower <= key < upper; both forms reach the Parquet scan."""
    test = F.lit(True)
    if lower is not None:
        test = test & (key >= binary(lower))
    if upper is not None:
        test = test & (key < binary(upper))
    return test


def has_prefix(key: Column, prefix: bytes) -> Column:
    """`startswith` as a bounded range, which (unlike `startswith` over binary) is pushed down."""
    return in_range(key, prefix, prefix_successor(prefix))
