"""Sessions of open documents as a stateful stream: each event publishes, a close drops the state.

A document has state from its open or change on (what to show, as it was last sent) until its close, or until
it has not been touched for the time to live. So what a stream holds falls with the documents that are
open, however many there have been. An open or a change replaces the state and publishes it; a save publishes
the state once more, and nothing where there is none; a close drops it and publishes a tombstone.

Events of a key are taken in their order within a micro-batch (the trigger bounds how many those are) and
micro-batches in the order of their arrival. Rows without a key are one document; kinds other than the four
do nothing; a null value is a value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OPEN, CHANGE, SAVE, CLOSE = "open", "change", "save", "close"
STATE = "shown"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DocumentSession(StatefulProcessor):
    """Keeps what is shown of one document."""

    def __init__(self, key: str, order: Sequence[str], value: str, value_type: str, ttl_ms: int | None = None):
        self.columns, self.order, self.value, self.value_type, self.ttl_ms = [key, *order, "kind", value], list(order), value, value_type, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState(STATE, f"{self.value} {self.value_type}", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        from pyspark.sql import Row

        published = Row(*self.columns)
        before = self.shown.get() if self.shown.exists() else None
        now = before
        for row in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.order)):
            kind = row["kind"]
            if kind in (OPEN, CHANGE):
                now = (row[self.value],)
            elif kind == CLOSE:
                now = None
            elif kind != SAVE or now is None:
                continue
            yield published(*key, *(row[c] for c in self.order), kind, now[0] if now is not None else None)
        if now is None and before is not None:
            self.shown.clear()
        elif now is not None:
            self.shown.update(tuple(now))

    def close(self) -> None:
        pass


@contextmanager
def state_in_rocks(spark: SparkSession):
    """Arbitrary state needs this store; the setting counts for queries that start inside."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, was) if was is not None else spark.conf.unset(STORE)


def sessions(events: DataFrame, key: str, order: Sequence[str], value: str, ttl_ms: int | None = None) -> DataFrame:
    """What a stream of events (key, order, kind, value) publishes: the same columns, a row for each that does."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    columns = [key, *order, "kind", value]
    return events.select(*columns).groupBy(key).transformWithState(
        DocumentSession(key, order, value, kinds[value], ttl_ms), ", ".join(f"{c} {kinds[c]}" for c in columns),
        outputMode="append", timeMode="ProcessingTime" if ttl_ms else "None")


def publish(events: DataFrame, key: str, order: Sequence[str], value: str, log: str, progress: str, ttl_ms: int | None = None, available_only: bool = True) -> StreamingQuery:
    """Start writing what the sessions publish as Parquet in log; each row is there once, after a restart too.

    With a time to live, Spark runs batches without events as well, so such a stream goes on until it is stopped.
    """
    with state_in_rocks(events.sparkSession):
        out = sessions(events, key, order, value, ttl_ms).writeStream.outputMode("append").format("parquet").option("path", log).option("checkpointLocation", progress)
        return (out.trigger(availableNow=True) if available_only and not ttl_ms else out).start()


def open_documents(spark: SparkSession, progress: str, key: str, value: str) -> DataFrame:
    """(key, value) of the documents that have state, read from a stream's checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(progress)
    held = "value.value" if "value" in state.selectExpr("value.*").columns and "ttlExpirationMs" in state.selectExpr("value.*").columns else "value"
    return state.selectExpr(f"key.{key} AS {key}", f"{held}.{value} AS {value}")
