"""Streams into a store, and a store's log as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import DEFAULT_CF, OP_LOG
from tidelog.sources.store import Store


def now() -> int:
    """Epoch milliseconds."""
    return int(time.time() * 1000)


def into_store(
    stream: DataFrame, store: Store, name: str, checkpoint: str, order: Sequence[str], compact: bool = False, clock: Callable[[], int] = now, mode: str = "append"
):
    """Start a query that commits each micro-batch to `store` as one batch.

    `order` (columns that order the records of a batch totally) fixes their sequence numbers.  A batch that is replayed
    after a failure is recognised by the query's name and its number, so each record is stored once.  With `compact` a
    batch is followed by the compaction that is due, whose time to live takes its time from `clock`, asked anew each time.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        at = store.refresh()
        at.write(batch, list(order), stream=(name, batch_id))
        if compact:
            at.maybe_compact(clock())

    writer = stream.writeStream.queryName(name).outputMode(mode).foreachBatch(commit)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_into_store(updates: DataFrame, op: str, key: Column, value: Column, order: Sequence[str], store: Store, name: str, checkpoint: str, cf: str = DEFAULT_CF):
    """Start a query that keeps a processor's updates as records of a store: puts of values and fields, merges of list elements.

    A batch adds what it changed, and the store's levels keep what has to be read in proportion to the state.
    """
    rest = [c for c in order if c not in ("cf", "op", "key", "value")]
    records = updates.select(F.lit(cf).alias("cf"), F.lit(op).alias("op"), key.cast("binary").alias("key"), value.cast("binary").alias("value"), *rest)
    return into_store(records, store, name, checkpoint, order, compact=True, mode="update")


def replay(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The records of log files under `path` as a stream; `max_files` a trigger admits writers' bursts piece by piece."""
    reader = spark.readStream.schema(OP_LOG)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
