"""Knowledge about types outside the corpus: (name, is_reference, inherited), one row a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.store import shared_folder, written


def upgrade(types: DataFrame, known: DataFrame) -> DataFrame:
    """types whose is_reference is null take it from known, and its inherited names beside their own.

    Types of known kind stay as they are, and so do those that known has not; of rows of known that
    repeat a name the one that sorts first counts.
    """
    once = known.groupBy("name").agg(F.min(F.struct("is_reference", "inherited")).alias("_known"))
    open_kind = F.col("is_reference").isNull() & F.col("_known").isNotNull()
    both = F.array_union(F.coalesce("inherited", F.array().cast("array<string>")), F.coalesce(F.col("_known.inherited"), F.array().cast("array<string>")))
    return (types.join(once, "name", "left")
            .withColumns({"is_reference": F.when(open_kind, F.col("_known.is_reference")).otherwise(F.col("is_reference")), "inherited": F.when(open_kind, both).otherwise(F.col("inherited"))})
            .select(*types.columns))


def confirmed(types: DataFrame, known: DataFrame) -> DataFrame:
    """(name): what strong properties refer to, that is no type itself, and that known says is a class."""
    names = types.filter("is_reference").select("name")
    refs = types.filter("is_reference").select(F.explode(F.expr("flatten(transform(filter(stored_properties, p -> p.strength = 'strong'), p -> p.refs))")).alias("name")).distinct()
    return refs.join(names, "name", "left_anti").join(known.filter("is_reference").select("name"), "name", "left_semi")


def pull_outside(edges: DataFrame, nodes: DataFrame, known: DataFrame, outside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph and of the classes outside it that it leads to.

    edges and outside (src, dst, ...) have the same columns: what names of the graph point to, and what types
    that are known point to; nodes (name) are the graph's names. A name that an edge points to, that is none of
    the nodes and that known (name, is_reference) says is a class, becomes a node, and its edges become edges,
    which may lead to more of them, until a round finds none. Of all edges those stay whose ends are different
    nodes. What is unknown, or a value, leads nowhere. Rounds are as many as the longest way outside.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark, "outside")
    own = nodes.select("name").filter("name is not null").distinct()
    classes = written(known.filter("is_reference").select("name").distinct().join(own, "name", "left_anti"), f"{folder}/classes")
    steps = written(outside.select(F.col("src").alias("name"), "dst").distinct().join(classes, "name", "left_semi")
                    .join(classes.select(F.col("name").alias("dst")), "dst", "left_semi").select("name", "dst"), f"{folder}/steps")
    front = written(edges.join(own, edges.src == own.name, "left_semi").select(F.col("dst").alias("name")).distinct().join(classes, "name", "left_semi"), f"{folder}/round-0")
    reached, rounds = front, 0
    while not front.isEmpty():
        rounds += 1
        found = front.join(steps, "name").select(F.col("dst").alias("name")).distinct()
        front = written(found.join(reached, "name", "left_anti"), f"{folder}/round-{rounds}")
        reached = reached.unionByName(front)
    every = own.unionByName(reached)
    both = edges.join(own, edges.src == own.name, "left_semi").unionByName(outside.join(reached, outside.src == reached.name, "left_semi"))
    ends = every.select(F.col("name").alias("dst"))
    return every, both.filter("src <> dst").join(ends, "dst", "left_semi").select(edges.columns)
