"""Writes: batches of records and their sequence numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.schema import DEFAULT_CF, DELETE, DELETE_RANGE, MERGE, OP_LOG, PUT, SINGLE_DELETE, InvalidArgument
from tidelog.sources.durable import durable


class WriteBatch:
    """An ordered list of records that is committed as a whole; for small batches built on the driver."""

    def __init__(self):
        self._records: list[tuple[str, str, bytes, bytes | None, bytes | None]] = []

    def _add(self, cf: str, op: str, key: bytes, end: bytes | None, value: bytes | None) -> WriteBatch:
        self._records.append((cf, op, bytes(key), end, value))
        return self

    def put(self, key: bytes, value: bytes, cf: str = DEFAULT_CF) -> WriteBatch:
        return self._add(cf, PUT, key, None, bytes(value))

    def delete(self, key: bytes, cf: str = DEFAULT_CF) -> WriteBatch:
        return self._add(cf, DELETE, key, None, None)

    def single_delete(self, key: bytes, cf: str = DEFAULT_CF) -> WriteBatch:
        return self._add(cf, SINGLE_DELETE, key, None, None)

    def merge(self, key: bytes, operand: bytes, cf: str = DEFAULT_CF) -> WriteBatch:
        return self._add(cf, MERGE, key, None, bytes(operand))

    def delete_range(self, begin: bytes, end: bytes, cf: str = DEFAULT_CF) -> WriteBatch:
        return self._add(cf, DELETE_RANGE, begin, bytes(end), None)

    def count(self) -> int:
        return len(self._records)

    def is_empty(self) -> bool:
        return not self._records

    def clear(self) -> None:
        self._records.clear()

    def records(self) -> list[dict]:
        return [{"cf": cf, "op": op, "key": k, "end_key": e, "value": v} for cf, op, k, e, v in self._records]

    def keyspaces(self) -> set[str]:
        return {r[0] for r in self._records}

    def replay(self, handler: BatchHandler) -> None:
        """Hand each record to `handler` in order."""
        for cf, op, key, end, value in self._records:
            if op == PUT:
                handler.put(cf, key, value)
            elif op == DELETE:
                handler.delete(cf, key)
            elif op == SINGLE_DELETE:
                handler.single_delete(cf, key)
            elif op == MERGE:
                handler.merge(cf, key, value)
            else:
                handler.delete_range(cf, key, end)

    def frame(self, spark: SparkSession, batch_id: int = 0, last_seq: int = 0) -> DataFrame:
        """The records as a log whose sequence numbers go on behind `last_seq`."""
        rows = [
            (cf, batch_id, i, last_seq + i + 1, op, bytearray(k), None if e is None else bytearray(e), None if v is None else bytearray(v), None)
            for i, (cf, op, k, e, v) in enumerate(self._records)
        ]
        return spark.createDataFrame(rows, OP_LOG)


class BatchHandler:
    """Receives a replayed batch; each call does nothing unless overridden."""

    def put(self, cf: str, key: bytes, value: bytes) -> None: ...
    def delete(self, cf: str, key: bytes) -> None: ...
    def single_delete(self, cf: str, key: bytes) -> None: ...
    def merge(self, cf: str, key: bytes, operand: bytes) -> None: ...
    def delete_range(self, cf: str, begin: bytes, end: bytes) -> None: ...


def multi_put(pairs: Iterable[tuple[bytes, bytes]], cf: str = DEFAULT_CF) -> WriteBatch:
    batch = WriteBatch()
    for k, v in pairs:
        batch.put(k, v, cf)
    return batch


def multi_delete(keys: Iterable[bytes], cf: str = DEFAULT_CF) -> WriteBatch:
    batch = WriteBatch()
    for k in keys:
        batch.delete(k, cf)
    return batch


def replay_counts(log: DataFrame) -> DataFrame:
    """Records by batch and kind, for batches of any size: batch_id, op, n, n_bytes."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + F.coalesce(F.octet_length("end_key"), F.lit(0))
    return log.groupBy("batch_id", "op").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("n_bytes"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with their place, from 0 on, in the order of the columns `order`, as the column `name`.

    Rows are sorted into ranges by one shuffle; a row's place is its place within its range plus the sizes of the
    ranges before.  Of equal rows any order may come.
    """
    spot = f"{name}_spot"
    sorted_ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # kept, since it is read twice below, and a second sampling of the ranges might cut them elsewhere
    placed = durable(sorted_ranges.withColumn(spot, F.monotonically_increasing_id()))
    part = F.shiftright(spot, 33).alias("part")  # the id's documented form: the partition above 33 bits, the row below
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("size"))  # one row per range
    running = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = F.broadcast(sizes.select(F.col("part").alias(f"{spot}_part"), F.coalesce(running, F.lit(0)).alias(f"{spot}_before")))
    found = placed.join(before, F.shiftright(spot, 33) == F.col(f"{spot}_part"))
    place = F.col(f"{spot}_before") + F.col(spot).bitwiseAND(F.lit((1 << 33) - 1))
    return found.withColumn(name, place.cast("long")).drop(spot, f"{spot}_part", f"{spot}_before")


def assign_sequence(records: DataFrame, order: list[str], last_seq: int = 0) -> DataFrame:
    """`records` with seq = last_seq + 1, 2, ... in the order of the columns `order`, which should order them totally.

    An own seq may be part of the order; it is replaced.
    """
    if not order:
        raise InvalidArgument("records need an order to be numbered")
    found = numbered(records, order, "new_seq")
    return found.drop("seq").withColumnRenamed("new_seq", "seq").withColumn("seq", F.col("seq") + F.lit(last_seq + 1))
