"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every document has a uniform hash. A source whose target is T of its S words takes every
document floor(T / S) times, and once more those whose hash lies under a cutoff. The cutoff
comes from histograms: words summed by source and by the leading bits of the hash show the
bucket in which the running sum passes the budget; only that bucket is summed again by the
next bits, so that no pass sorts documents. A source gets within half a document of its target.

Defined results: null text has size 0; null is a source, the last one; a source without words
gets target 0; rows with equal ids (or, without ids, equal texts) are taken alike; no row is
taken more than twice; an empty table gives an empty result; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
HASH_BITS = 60
LEVEL_BITS = 12
LEVELS = 3
#: Per-source cutoffs are broadcast up to this many sources, else joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 uniform bits of a document's id; of its text where the id is null."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Targets are in proportion to the weights until a source reaches `most` times its size;
    with sources sorted by size per weight, the level of the others is a running quotient.
    One task orders the list of sources, never their documents.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    rising = Window.orderBy("ratio", "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    listed = (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * float(share)
                    - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("budget") / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    )
    return listed.select(
        "source", "source_size",
        F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"),
    )


def cutoffs(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, base, cutoff): base copies of all, one more under cutoff.

    rows: (source, hash, size).
    """
    goals = cut(goals.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
                .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")))
    here = goals.filter("budget > 0").select("source", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("done"), "budget")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        keyed = rows.withColumn("bucket", F.shiftright("hash", shift + LEVEL_BITS)).withColumn("next", F.shiftright("hash", shift))
        inside = (keyed.alias("r").join(here.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
                  .groupBy("b.source", "b.done", "b.budget", "next").agg(F.sum("size").alias("words")))
        running = Window.partitionBy("source").orderBy("next")
        here = cut(
            inside.withColumn("upto", F.col("done") + F.sum("words").over(running))
            .withColumn("done", F.col("upto") - F.col("words"))
            .filter((F.col("done") < F.col("budget")) & (F.col("budget") <= F.col("upto")))
            .select("source", F.col("next").alias("bucket"), "done", "budget")
        )
    shift = HASH_BITS - LEVEL_BITS * LEVELS
    keyed = rows.withColumn("bucket", F.shiftright("hash", shift))
    last = (keyed.alias("r").join(here.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
            .groupBy("b.source", "b.bucket", "b.done", "b.budget", "hash").agg(F.sum("size").alias("words")))
    running = Window.partitionBy("source").orderBy("hash")
    edge = (
        last.withColumn("upto", F.col("done") + F.sum("words").over(running))
        .withColumn("out", F.when(F.col("upto") - F.col("words") / 2 >= F.col("budget"), F.col("hash")))
        .groupBy("source", "bucket").agg(F.min("out").alias("out"))
        .select("source", F.coalesce("out", F.shiftleft(F.col("bucket") + 1, shift)).alias("cutoff"))
    )
    return (goals.alias("g").join(edge.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left")
            .select("g.source", "source_size", "target", "base", F.coalesce("cutoff", F.lit(0).cast("long")).alias("cutoff")))


def with_copies(rows: DataFrame) -> DataFrame:
    """rows (source, hash, size, ...) with source_size, target and copies."""
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    marks = cut(cutoffs(rows.select("source", "hash", "size"), goals)).withColumnRenamed("source", "of")
    if marks.count() <= BROADCAST_SOURCES:
        marks = F.broadcast(marks)
    copies = F.col("base") + (F.col("hash") < F.col("cutoff")).cast("long")
    return (rows.join(marks, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("copies", copies).drop("of", "base", "cutoff"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, size, source_size, target, taken."""
    rows = cut(docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        row_hash(F.col("doc_id"), F.col("text")).alias("hash"), word_count(F.col("text")).alias("size")))
    return with_copies(rows).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns stay the same."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    slim = cut(keyed.select(
        F.col("row.source").cast("string").alias("source"),
        row_hash(F.col("row.doc_id"), F.col("row.text")).alias("hash"), word_count(F.col("row.text")).alias("size")))
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    marks = cut(cutoffs(slim, goals)).select(F.col("source").alias("of"), "base", "cutoff")
    if marks.count() <= BROADCAST_SOURCES:
        marks = F.broadcast(marks)
    copies = F.col("base") + (row_hash(F.col("row.doc_id"), F.col("row.text")) < F.col("cutoff")).cast("long")
    return (keyed.join(marks, F.col("row.source").cast("string").eqNullSafe(F.col("of")))
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*"))
