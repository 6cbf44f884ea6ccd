"""Connected components by hooking and pointer doubling, as joins and aggregations over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.store import written


def connected_components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of links (a, b), longs: root is the least node of its component.

    Every node has a parent, at first the least of itself and its neighbours. Each round it looks at the
    grandparents of its neighbours: the least of them becomes its own parent and its parent's, if it is
    less than theirs, and every node moves up to its grandparent. Trees flatten while they merge, so
    rounds grow with the logarithm of the longest path. It is over when no parent and no grandparent
    has changed: both only ever fall, so their sums tell. Null ends and links of a node with itself
    are left out; tables of the rounds are written below folder.
    """
    links = links.filter("a <> b")
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")).select("x.*")

    def settled(parents: DataFrame, name: str):
        """(node, parent, top) written, and the sums of both."""
        state = written(parents.join(parents.toDF("parent", "top"), "parent").select("node", "parent", "top"), f"{folder}/{name}")
        return state, state.agg(*[F.sum(F.col(c).cast("decimal(20,0)")) for c in ("parent", "top")]).first()

    state, sums = settled(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "0")
    rounds = 0
    while True:
        rounds += 1
        around = both.join(state.select(F.col("node").alias("other"), "top"), "other").groupBy("node").agg(F.min("top").alias("least"))
        hooks = state.join(around, "node").select(F.explode(F.array(
            F.struct("node", F.least("parent", "top", "least").alias("to")), F.struct(F.col("parent").alias("node"), F.col("least").alias("to")))).alias("x"))
        state, now = settled(hooks.groupBy("x.node").agg(F.min("x.to").alias("parent")), str(rounds))
        if now == sums:
            return state.select("node", F.col("parent").alias("root"))
        sums = now
