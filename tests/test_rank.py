"""Leader clustering in rounds against the sequential order, and running numbers over ranges."""

import numpy as np
import pytest

from orbweave.operators import rank

SCHEMA = "g string, at int, v array<double>"


def sequential(rows, threshold):
    out, leaders = {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        v = np.array(v or [], dtype=float)
        v = v / np.linalg.norm(v) if np.linalg.norm(v) else v
        own = leaders.setdefault(g, [])
        near = [name for name, x in own if len(x) == len(v) and len(v) and x @ v >= threshold]
        out[g, at] = near[0] if near else at
        if not near:
            own.append((at, v))
    return out


def some(seed, n=300):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.integers(0, 3)) if rng.random() < 0.9 else None, k, rng.normal(size=4 if rng.random() < 0.9 else 3).tolist()) for k in range(n)]
    return rows + [("0", n, None), ("0", n + 1, []), ("0", n + 2, [0.0] * 4), ("1", n + 3, rows[0][2])]


@pytest.mark.parametrize(("block", "part", "threshold"), [(512, 20_000, 0.6), (5, 20, 0.6), (3, 7, 0.9), (40, 11, -0.5)])
def test_rounds_give_the_sequential_clusters(spark, block, part, threshold):
    rows = some(block, 120 if block < 6 else 300)
    got = rank.leader_clusters(spark.createDataFrame(rows, SCHEMA), "g", "at", "v", threshold, block, part).collect()
    assert len(got) == len(rows)
    assert {(r.g, r["at"]): r.leader for r in got} == sequential(rows, threshold)


def test_four_rows_in_two_shapes(spark):
    a, z = [1.0, 0.0], [0.0, 1.0]
    rows = spark.createDataFrame([("all", k, v) for k, v in enumerate([a, z, a, z], 1)], SCHEMA)
    placed = rank.by_cluster(rows, rank.leader_clusters(rows, "g", "at", "v"), "g", "at").collect()
    assert [r["at"] for r in sorted(placed, key=lambda r: r.position)] == [1, 3, 2, 4]


def test_numbers_over_many_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 AS x", "id % 3 AS y")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = rank.numbered(rows, ["x"], "n").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.n == r.x + 1 for r in got) and len(got) == 5000
    assert rank.numbered(rows.limit(0), ["x"]).count() == 0


def test_empty_table(spark):
    assert rank.leader_clusters(spark.createDataFrame([], SCHEMA), "g", "at", "v").count() == 0
