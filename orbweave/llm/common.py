"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators.store import cut, remove, shared_folder, written  # noqa: F401  for the operators

#: A word, as a regular expression of Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key that holds more than one row in HOT_SHARE is hot; fewer than HOT_SHARE keys can be.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker's memory stays bounded."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner-join rows with groups, one row per key, where a few keys may hold most rows.

    A key whose weight is over total / HOT_SHARE is joined by broadcast: the weights
    add up to total at most, so there are fewer than HOT_SHARE such keys. All other
    keys are joined by a shuffle, in which none of them can fill a task.
    """
    hot = F.col(weight) * HOT_SHARE > F.lit(total)
    few = groups.filter(hot)
    return (
        rows.join(F.broadcast(few), key)
        .unionByName(
            rows.join(F.broadcast(few.select(key)), key, "left_anti")
            .join(groups.filter(~hot), key)
        )
    )


def numbers(values: list[int]) -> Column:
    """A constant array of longs, folded into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bounds_at_most(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most value, found by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    marks = numbers(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(marks, at + s - 1) <= value, at + s).otherwise(at))
