"""The latest state of each document from a stream of opens, changes and closes.

The stream keeps one row of state a key (its latest event by an order that has no ties) and writes the
keys that a micro-batch touched to a change log, a folder for each batch. A batch that runs again after
a failure replaces its own folder, so every change is there once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(events: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(key, order, values): the latest event of each key; works on streams and on tables."""
    kept = [*order, *[v for v in values if v not in order]]
    best = events.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("e"))
    return best.select(key, *[F.col(f"e.{c}").alias(c) for c in kept])


def follow(events: DataFrame, key: str, order: Sequence[str], values: Sequence[str], log: str, progress: str, available_only: bool = True) -> StreamingQuery:
    """Start writing the change log of a stream; progress is the folder of its offsets and state."""

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{log}/batch={batch}")

    out = latest(events, key, order, values).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress)
    return (out.trigger(availableNow=True) if available_only else out).start()


def current(spark: SparkSession, log: str, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The state that a change log has come to."""
    return latest(spark.read.parquet(log), key, order, values)


CLOSE, SAVE = "close", "save"


def publish(events: DataFrame, key: str, order: Sequence[str], value: str, log: str, progress: str) -> StreamingQuery:
    """Start the log of what to show for each document, from a stream of opens, changes, saves and closes (kind).

    A batch logs every key that it touches: the value that its latest open or change left, again after a
    save, or a tombstone (kind close, no value) after a close. A save without anything to show logs nothing.
    """
    counts = F.when(F.col("kind") != SAVE, F.struct(*order))
    shown = F.struct(*order, "kind", F.when(F.col("kind") != CLOSE, F.col(value)).alias(value))
    state = events.groupBy(key).agg(F.max_by(shown, counts).alias("e")).filter("e is not null").select(key, "e.*")

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{log}/batch={batch}")

    return state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def published(spark: SparkSession, log: str, key: str, order: Sequence[str], value: str) -> DataFrame:
    """The last row that a log has of each key, tombstones too."""
    return latest(spark.read.parquet(log), key, order, [*order, "kind", value])
