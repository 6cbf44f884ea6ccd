"""Vectors as arrays: cosine similarity, mean pooling, and hashed n-gram embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.hashing import BASIS, PRIME


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty, or a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, position, mean): the mean vector of each key, one row a position; partial sums combine."""
    return rows.select(key, F.posexplode(vector).alias("position", "x")).groupBy(key, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def _histograms(batches: Iterator, n: int, buckets: int) -> Iterator:
    """Rows (key, text) to (key, bucket, n): FNV-1a over the code points of each n-gram, in numpy."""
    import pyarrow as pa

    for batch in batches:
        rows, kinds, counts = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            points = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            grams = max(len(points) - n + 1, min(len(points), 1))
            state = np.full(grams, BASIS, dtype=np.uint64)
            for k in range(min(n, len(points))):
                state = (state ^ points[k : k + grams]) * np.uint64(PRIME)
            held = np.bincount((state % np.uint64(buckets)).astype(np.int64), minlength=buckets)
            some = np.flatnonzero(held)
            rows.append(np.full(len(some), i))
            kinds.append(some)
            counts.append(held[some])
        taken = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(taken)), pa.array(np.concatenate(kinds) if kinds else taken), pa.array(np.concatenate(counts) if counts else taken)], names=["key", "bucket", "n"])


def ngram_histogram(rows: DataFrame, key: str, text: str, n: int = 3, buckets: int = 128) -> DataFrame:
    """(key, bucket, n) of each row: how many of its n-grams of characters fall in each bucket that has some.

    A text shorter than n is one n-gram; a null or empty one has none. No row leaves its partition.
    """
    kind = dict(rows.select(key).dtypes)[key]
    return rows.select(key, text).mapInArrow(partial(_histograms, n=n, buckets=buckets), f"key {kind}, bucket long, n long").withColumnRenamed("key", key)


def _similar(batches: Iterator, threshold: float, digits: int) -> Iterator:
    """Rows (cell, left, id, vector) of whole cells, one after the other, to similar (a, b, similarity) by one product of matrices a cell."""
    import pyarrow as pa

    def pairs(rows):
        left, right = ([(i, v) for is_left, i, v in rows if is_left is side] for side in (True, False))
        if not left or not right:
            return
        by_size = lambda side: {n: [(i, v) for i, v in side if len(v) == n] for n in {len(v) for _, v in side}}
        lefts, rights = by_size(left), by_size(right)
        for n in lefts.keys() & rights.keys() - {0}:
            (x, p), (y, q) = (([i for i, _ in side], np.array([v for _, v in side], dtype=np.float64)) for side in (lefts[n], rights[n]))
            norms = np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
            sim = np.round(np.divide(p @ q.T, norms, out=np.zeros_like(norms), where=norms > 0), digits)
            for i, j in zip(*np.nonzero(sim >= threshold), strict=True):
                if x[i] < y[j]:
                    yield x[i], y[j], float(sim[i, j])

    now, rows, kind = None, [], None
    for batch in batches:
        kind = batch.schema.field(2).type
        out = []
        for cell, is_left, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if cell != now:
                out += pairs(rows)
                now, rows = cell, []
            rows.append((is_left, i, v))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((kind, kind, pa.float64()))], names=["a", "b", "similarity"])
    if out := list(pairs(rows)):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((kind, kind, pa.float64()))], names=["a", "b", "similarity"])


def similar_pairs(rows: DataFrame, group: str, key: str, vector: str, threshold: float, block: int = 1024, digits: int = 4) -> DataFrame:
    """(a, b, similarity) of the pairs a < b of a group whose cosine, rounded, reaches threshold.

    Groups are cut into blocks of about `block` rows by a hash of the key, and every two blocks meet in a
    cell that one product of matrices settles, so a task holds two blocks at most and only similar pairs
    are ever made. Rows with a null group, key or vector are in no pair.
    """
    known = rows.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(vector).alias("v")).dropna()
    sizes = known.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = known.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = lambda left: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.when(F.lit(left), F.col("own")).otherwise(o).alias("x"), F.when(F.lit(left), o).otherwise(F.col("own")).alias("y"), F.lit(left).alias("is_left")))
    dealt = own.select("g", "id", "v", F.explode(F.concat(cells(True), cells(False))).alias("c"))
    kind = dict(rows.select(key).dtypes)[key]
    return (dealt.select(F.to_json(F.struct("g", "c.x", "c.y")).alias("cell"), "c.is_left", "id", "v").repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(partial(_similar, threshold=threshold, digits=digits), f"a {kind}, b {kind}, similarity double"))
