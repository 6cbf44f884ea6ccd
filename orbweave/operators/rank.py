"""Leader clustering in arrival order by rounds, and running numbers over a whole table.

A vector joins the first leader that is similar enough, else it becomes a leader itself, so what a vector does
depends on those before it. A round takes each group's earliest vectors without a cluster, a block of
bounded size, and settles them one after the other; no earlier leader is near them, or they would be gone.
Then all other vectors of the group meet only the block's leaders, in partitions that a group with many
vectors has many of, and join the first that is similar enough. Rounds go on until every vector has one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.store import remove, shared_folder, written

#: Vectors of a group that a round settles in order; at most what Spark limits in the map side's part of a window.
BLOCK = 512
#: Vectors of a group that meet the leaders in one partition.
PART = 20_000


def _unit(values) -> np.ndarray:
    v = np.array(values or [], dtype=np.float64)
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def _first_near(v: np.ndarray, leaders: list[np.ndarray], threshold: float) -> int | None:
    """Which of the leaders is the first that is similar; those of another length are not."""
    same = [k for k, x in enumerate(leaders) if len(x) == len(v)]
    if not same or not len(v):
        return None
    near = np.flatnonzero(np.stack([leaders[k] for k in same]) @ v >= threshold)
    return same[near[0]] if len(near) else None


def _settle(table, threshold: float):
    """One group's block (group, order, vector), in order: leader is the order value of a vector's leader."""
    import pyarrow as pa

    group, order, vectors = (table.column(k).to_pylist() for k in range(3))
    leaders, names, chosen = [], [], {}
    for i in sorted(range(len(order)), key=order.__getitem__):
        v = _unit(vectors[i])
        k = _first_near(v, leaders, threshold)
        if k is None:
            leaders.append(v)
            names.append(order[i])
        chosen[i] = order[i] if k is None else names[k]
    schema = table.schema
    return pa.table({schema.names[0]: table.column(0), schema.names[1]: table.column(1), schema.names[2]: table.column(2),
                     "leader": pa.array([chosen[i] for i in range(len(order))], schema.field(1).type)})


def _meet(rows, leaders, threshold: float):
    """A part of a group (group, part, order, vector) with the block's leaders (group, part, leader, vector): leader, or null."""
    import pyarrow as pa

    by_order = leaders.sort_by("leader")
    names, vectors = by_order.column("leader").to_pylist(), [_unit(v) for v in by_order.column(3).to_pylist()]
    near = [_first_near(_unit(v), vectors, threshold) for v in rows.column(3).to_pylist()]
    return rows.append_column("leader", pa.array([None if k is None else names[k] for k in near], rows.schema.field(2).type))


def leader_clusters(rows: DataFrame, group: str, order: str, vector: str, threshold: float = 0.82, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(group, order, leader): leader is the order value of the first vector of its cluster.

    order must differ within a group. A vector without length or values is near to nothing, so it leads itself
    (unless the threshold is not positive); vectors of different lengths are apart; null is a group.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "leaders")
    kinds = dict(rows.dtypes)
    columns = f"{group} {kinds[group]}, {order} {kinds[order]}, {vector} {kinds[vector]}, leader {kinds[order]}"
    parts = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / part).alias("_parts"))
    same = lambda a, b: a[group].eqNullSafe(b[group])
    left = rows.select(group, order, vector)
    left = left.join(parts, same(left, parts)).select(left[group], "_parts", F.pmod(F.xxhash64(order), F.col("_parts")).alias("_part"), order, vector)
    left, number, settled = written(left, f"{folder}/left-0"), 0, []
    while not left.isEmpty():
        number += 1
        first = left.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_k") <= block)
        done = written(first.select(group, order, vector, "_parts").groupBy(group, "_parts").applyInArrow(lambda t: _settle_with_parts(t, threshold), columns + ", _parts long"), f"{folder}/block-{number}")
        leaders = done.filter(F.col("leader") == F.col(order)).select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), "leader", vector)
        last = done.groupBy(group).agg(F.max(order).alias("_last"))
        rest = left.join(last, same(left, last)).filter(F.col(order) > F.col("_last")).select(left[group], "_parts", "_part", order, vector)
        met = written(rest.select(group, "_part", order, vector, "_parts").groupBy(group, "_part").cogroup(leaders.groupBy(group, "_part")).applyInArrow(
            lambda a, b: _meet(a, b, threshold), f"{group} {kinds[group]}, _part long, {order} {kinds[order]}, {vector} {kinds[vector]}, _parts long, leader {kinds[order]}"), f"{folder}/met-{number}")
        settled += [done.select(group, order, "leader"), met.filter("leader is not null").select(group, order, "leader")]
        remove(spark, f"{folder}/left-{number - 1}")
        left = written(met.filter("leader is null").select(group, "_parts", "_part", order, vector), f"{folder}/left-{number}")
    out = rows.select(group, order, F.col(order).alias("leader")).limit(0)
    for table in settled:
        out = out.unionAll(table)
    return out


def _settle_with_parts(table, threshold: float):
    done = _settle(table.select([0, 1, 2]), threshold)
    return done.append_column("_parts", table.column("_parts"))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """rows with their place in the order of the whole table, from 1; ties are numbered too, in any order.

    Rows are sorted by range, so no task sees all of them: each range numbers its own, and the rows of the
    ranges before it are added. The driver sees nothing; the list of ranges is as long as there are tasks.
    """
    folder = shared_folder(rows.sparkSession, "numbered")
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranges.select("*", F.monotonically_increasing_id().alias("_at")), f"{folder}/ranges")
    of, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(of.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.withColumn("_range", of).join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + within + 1).drop("_range", "_base", "_at")


def by_cluster(rows: DataFrame, clusters: DataFrame, group: str, order: str, name: str = "position") -> DataFrame:
    """rows with the place that shows clusters (group, order, leader) one after the other.

    Groups in order; in a group clusters by their first member; in a cluster members by their own order. Rows without
    a cluster stay where they are: they lead themselves.
    """
    led = clusters.select(F.col(group).alias("_g"), F.col(order).alias("_o"), "leader")
    joined = rows.join(led, rows[group].eqNullSafe(F.col("_g")) & (rows[order] == F.col("_o")), "left").drop("_g", "_o")
    return numbered(joined.withColumn("leader", F.coalesce("leader", order)), [group, "leader", order], name)
