"""Joins that Spark has no single operator for, each as a shuffle on equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """left with the values of the latest row of right (by at, order) whose keys agree and whose at
    is not later.

    Both sides are united and the values carried forward along each key, so the work is one sort by
    key instead of a comparison of all pairs. Rows of right count on their own place.
    """
    marked = right.select(*keys, at, *order, F.struct(*values).alias("_carried"), F.lit(0).alias("_side"))
    rows = left.select(*keys, at, F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"))
    both = marked.unionByName(rows, allowMissingColumns=True)
    along = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_side"), *[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("_carried", F.last("_carried", ignorenulls=True).over(along)).filter("_side = 1")
            .select("_row.*", *[F.col(f"_carried.{v}").alias(v) for v in values]))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, width: int) -> DataFrame:
    """Rows whose keys agree and whose integers at and other differ by width at most.

    Left rows lie in one bucket of width + 1, right rows are dealt to theirs and both neighbours, so
    a key with many rows is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / (width + 1)).cast("long")
    near = right.withColumn("_bucket", F.explode(F.array(bucket(other) - 1, bucket(other), bucket(other) + 1)))
    return left.withColumn("_bucket", bucket(at)).join(near, [*keys, "_bucket"]).filter(F.abs(F.col(at) - F.col(other)) <= width).drop("_bucket")


def best_match(pairs: DataFrame, keys: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """For each key the values of the pair that comes first in order; partial minima combine."""
    best = pairs.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def first_match(calls: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """calls (key, callee, base, labels) with the first of contracts (ord, callee, base, required,
    template) that applies: equal callee, equal base if one is named, all required labels there."""
    c = contracts.select("ord", F.col("callee").alias("_callee"), F.col("base").alias("_base"), "required", "template")
    applies = (F.col("callee") == F.col("_callee")) & (F.col("_base").isNull() | F.coalesce(F.col("base") == F.col("_base"), F.lit(False))) & (
        F.size(F.array_except("required", "labels")) == 0)
    return best_match(calls.join(c, applies), [key], F.col("ord"), ["ord", "template"])


def split_known(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not among known, rows whose key is)."""
    ids = known.select(key).distinct()
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi")
