"""Keyed state kept by streaming queries: value, list and map state on the engine's own state store.

Each processor is for `groupBy(key).transformWithState`.  A time to live needs processing-time mode; in batch reads use
`tidelog.functions.filters` instead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def close(self) -> None:
        pass


class Counter(_Keyed):
    """Value state: the number of rows seen per key."""

    output = "key string, n long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        before = self.count.get()[0] if self.count.exists() else 0
        now = before + sum(1 for _ in rows)
        self.count.update((now,))
        yield Row(key=key[0], n=now)


class Appender(_Keyed):
    """List state: the values seen per key, in the order in which they came; a batch's new elements go out."""

    output = "key string, seq long, value string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        new = sorted(((r["seq"], r["value"]) for r in rows), key=lambda r: r[0])
        self.items.appendList([(value,) for _, value in new])
        for seq, value in new:
            yield Row(key=key[0], seq=seq, value=value)


class Fields(_Keyed):
    """Map state: the newest value per key and field; the fields that a batch set go out."""

    output = "key string, field string, value string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "value string", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        new = {r["field"]: r["value"] for r in sorted(rows, key=lambda r: r["seq"])}
        for field, value in new.items():
            self.fields.updateValue((field,), (value,))
            yield Row(key=key[0], field=field, value=value)


def keep_state(rows: DataFrame, processor: _Keyed, key: str = "key") -> DataFrame:
    """The processor's output over `rows`, a streaming DataFrame or (for a one-off run) a batch one."""
    if not rows.isStreaming:
        # a session that has run no stream yet has no coordinator of state stores; only a classic session lets us start it
        rows.sparkSession._jsparkSession.sessionState().streamingQueryManager().stateStoreCoordinator()
    mode = "ProcessingTime" if processor.ttl_ms is not None else "None"
    return rows.groupBy(key).transformWithState(processor, processor.output, "Update", mode)
