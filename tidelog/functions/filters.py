"""Compaction filters: what a rewrite of state keeps, drops or changes, as column expressions.

A filter maps (key, value, ts) to a decision and, for changes, a value.  All clocks are explicit: `now` is bound once
per job, so a retried task decides as the first did.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.scalar import from_fixed_be, from_fixed_le
from tidelog.schema import InvalidArgument

KEEP, REMOVE, CHANGE, SKIP = "keep", "remove", "change", "skip"


@dataclass(frozen=True)
class CompactionFilter:
    """`decide` gives KEEP, REMOVE, CHANGE or SKIP; `change` the new value; `skip_until` the key a SKIP goes up to.

    A filter with `left` decides by the value that it leaves, which is computed once a row: null removes.
    """

    name: str
    decide: Callable[[Column, Column, Column], Column] | None = None
    change: Callable[[Column, Column, Column], Column] | None = None
    skip_until: Callable[[Column, Column], Column] | None = None
    left: Callable[[Column], Column] | None = None

    def decided(self, rows: DataFrame, asked: Column) -> DataFrame:
        """`rows` (key, value, ts and others) with decision, null where it is not `asked`, and changed values."""
        key, value, ts = F.col("key"), F.col("value"), F.col("ts")
        if self.left is not None:
            marked = rows.withColumn("left_", self.left(value)).withColumn("asked_", F.coalesce(asked, F.lit(False)))
            kind = F.when(value.isNull() | (F.col("left_") == value), KEEP).when(F.col("left_").isNull(), REMOVE).otherwise(CHANGE)
            decision = F.when(F.col("asked_"), kind)
            changed = marked.withColumn("decision", decision).withColumn("value", F.when(F.col("decision") == CHANGE, F.col("left_")).otherwise(value))
            return changed.drop("left_", "asked_")
        marked = rows.withColumn("decision", F.when(asked, self.decide(key, value, ts)))
        if self.change is not None:
            marked = marked.withColumn("value", F.when(F.col("decision") == CHANGE, self.change(key, value, ts)).otherwise(value))
        return marked


def timestamp_at(offset: int = 0, little: bool = False) -> Callable[[Column], Column]:
    """Reads 8-byte epoch milliseconds at a byte offset; null where the value is shorter."""
    read = from_fixed_le if little else from_fixed_be
    return lambda value: read(F.substring(value, offset + 1, 8), 8)


VALUE_OFFSET, MAP_OFFSET = 0, 1


def expired(stamp: Column, now_ms: int, ttl_ms: int) -> Column:
    """Strictly older than the time to live.  A stamp in the future has age 0; no stamp never expires."""
    age = F.greatest(F.lit(now_ms) - stamp, F.lit(0))
    return F.coalesce(age > ttl_ms, F.lit(False))


def value_ttl(now_ms: int, ttl_ms: int, extract: Callable[[Column], Column] | None = None) -> CompactionFilter:
    read = extract or timestamp_at(VALUE_OFFSET)
    return CompactionFilter("value_ttl", lambda key, value, ts: F.when(expired(read(value), now_ms, ttl_ms), REMOVE).otherwise(KEEP))


def column_ttl(now_ms: int, ttl_ms: int) -> CompactionFilter:
    """By the record's own ts column."""
    return CompactionFilter("column_ttl", lambda key, value, ts: F.when(expired(F.unix_millis(ts), now_ms, ttl_ms), REMOVE).otherwise(KEEP))


def unexpired_tail(elements: Column, stamp: Callable[[Column], Column], now_ms: int, ttl_ms: int) -> Column:
    """A typed list from its first fresh element on: older ones go only as a prefix."""
    dead = F.transform(elements, lambda e: expired(stamp(e), now_ms, ttl_ms))
    first = F.array_position(dead, False)
    return F.when(first > 0, F.slice(elements, first.cast("int"), F.size(elements))).otherwise(F.slice(elements, 1, 0))


def framed_tail(data: bytes, now_ms: int, ttl_ms: int) -> bytes | None:
    """Like `unexpired_tail` for framed bytes: 4-byte length, then 8-byte stamp and payload (the length covers both).

    None if all elements have expired; frames that break off keep the rest as it is.
    """
    at = 0
    while at + 12 <= len(data):
        size, stamp = struct.unpack_from(">Iq", data, at)
        if max(0, now_ms - stamp) <= ttl_ms or size < 8:
            return data[at:]
        at += 4 + size
    return data[at:] if at < len(data) else None if data else data


def list_ttl(now_ms: int, ttl_ms: int, unexpired_offset: Callable[[bytes], int] | None = None) -> CompactionFilter:
    """Cuts the expired prefix of framed lists; `unexpired_offset` may give the first offset to keep for other layouts.

    An offset of 0 or less keeps the value, one at or beyond its end removes it.
    """

    def cut(data: bytes) -> bytes | None:
        if unexpired_offset is None:
            return framed_tail(data, now_ms, ttl_ms)
        at = unexpired_offset(data)
        return data if at <= 0 else None if at >= len(data) else data[at:]

    def body(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else cut(bytes(v)) for v in values.cast(pa.binary()).to_pylist()], pa.binary())

    def tail(value: Column) -> Column:
        return F.arrow_udf(body, "binary")(value)

    return CompactionFilter("list_ttl", left=tail)


@dataclass(frozen=True)
class TtlConfig:
    """kind: disabled, value, map or list."""

    kind: str = "disabled"
    ttl_ms: int = 0

    def filter(self, now_ms: int) -> CompactionFilter | None:
        """The filter for one job, whose clock is bound here."""
        if self.kind == "disabled":
            return None
        if self.kind == "list":
            return list_ttl(now_ms, self.ttl_ms)
        if self.kind in ("value", "map"):
            return value_ttl(now_ms, self.ttl_ms, timestamp_at(MAP_OFFSET if self.kind == "map" else VALUE_OFFSET))
        raise InvalidArgument(f"no time to live of kind {self.kind!r}")
