"""Keyed state over a log: value, list and map state as views and as records to append.

Value state is a put per key.  List state appends by merge records.  Map state stores each entry under
``key:field`` and lists a key's entries by prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.merge import string_append
from tidelog.operators.reads import prefix_scan, scan
from tidelog.schema import DEFAULT_CF, DELETE, MERGE, PUT

JOINT = b":"


def _records(df: DataFrame, cf: str, op: str, key: Column, value: Column, seq: Column) -> DataFrame:
    return df.select(F.lit(cf).alias("cf"), seq.cast("long").alias("seq"), F.lit(op).alias("op"), key.cast("binary").alias("key"), value.cast("binary").alias("value"))


def value_updates(df: DataFrame, key: Column, value: Column, seq: Column, cf: str = DEFAULT_CF) -> DataFrame:
    return _records(df, cf, PUT, key, value, seq)


def clears(df: DataFrame, key: Column, seq: Column, cf: str = DEFAULT_CF) -> DataFrame:
    return _records(df, cf, DELETE, key, F.lit(None), seq)


def list_appends(df: DataFrame, key: Column, element: Column, seq: Column, cf: str = DEFAULT_CF) -> DataFrame:
    return _records(df, cf, MERGE, key, element, seq)


def map_puts(df: DataFrame, key: Column, field: Column, value: Column, seq: Column, cf: str = DEFAULT_CF) -> DataFrame:
    whole = F.concat(key.cast("binary"), F.lit(bytearray(JOINT)), field.cast("binary"))
    return _records(df, cf, PUT, whole, value, seq)


def value_state(log: DataFrame, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
    return scan(log, cf, read_seq).select("key", "value")


def list_state(log: DataFrame, cf: str = DEFAULT_CF, read_seq: int | None = None, delimiter: bytes = b",") -> DataFrame:
    """key and elements, oldest first.  Elements that hold the delimiter come back in parts, as they were joined."""
    state = scan(log, cf, read_seq, string_append(delimiter))
    return state.select("key", F.split(F.col("value").cast("string"), "\\Q" + delimiter.decode() + "\\E").alias("elements"))


def map_state(log: DataFrame, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
    """key, field and value of every entry; the first joint in a stored key ends the key."""
    text = F.col("key").cast("string")
    state = scan(log, cf, read_seq)
    return state.select(F.substring_index(text, ":", 1).alias("key"), F.expr("substring(string(key), instr(string(key), ':') + 1)").alias("field"), "value")


def map_entries(log: DataFrame, key: bytes, cf: str = DEFAULT_CF, read_seq: int | None = None) -> DataFrame:
    """The entries of one key, by a pushed-down prefix range."""
    state = prefix_scan(log, key + JOINT, cf, read_seq)
    return state.select(F.expr("substring(string(key), instr(string(key), ':') + 1)").alias("field"), "value")


def map_counts(log: DataFrame, cf: str = DEFAULT_CF) -> DataFrame:
    return map_state(log, cf).groupBy("key").agg(F.count(F.lit(1)).alias("n_fields"))
