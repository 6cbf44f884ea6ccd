"""Receiver chains whose links are rows, and locals that other code of their context refers to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Links that end a chain, that keep it running, types that do, and the pair that does together.
FINITE = ("first", "prefix", "output", "dataTaskPublisher", "Just", "Empty", "Fail", "Future", "Record", "Deferred")
INFINITE = ("publish",)
SUBJECTS = ("PassthroughSubject", "CurrentValueSubject")
CENTER = ("publisher", "NotificationCenter")


def classify(links: DataFrame, keys: Sequence[str], order: Column, name: str = "name", member: str = "is_member") -> DataFrame:
    """(keys, upstream, root): whether what a chain receives ends, and the member of its own type that it starts from.

    links has a row a link; order grows from the call towards the chain's start. A link that ends the chain wins
    (finite); then a name that starts with $, a link or a type that never ends, or both names of the notification
    center anywhere in the chain make it infinite; otherwise it is unknown. root is the last name by order whose
    member is true, or null. Null names, and links whose member is null, say nothing. Everything is a partial aggregate
    of a few flags, so a chain that holds a third of all links is no hot key.
    """
    link = F.col(name)
    has = lambda *names: F.coalesce(F.bool_or(link.isin(*names)), F.lit(False))
    flags = links.groupBy(*keys).agg(
        has(*FINITE).alias("_ends"), (has(*INFINITE, *SUBJECTS) | F.coalesce(F.bool_or(F.startswith(link, F.lit("$"))), F.lit(False)) | (has(CENTER[0]) & has(CENTER[1]))).alias("_runs"),
        F.max_by(link, F.when(F.col(member) & link.isNotNull(), order)).alias("root"))
    return flags.select(*keys, F.when(F.col("_ends"), "finite").when(F.col("_runs"), "infinite").otherwise("unknown").alias("upstream"), "root")


def resolve_roots(chains: DataFrame, running: DataFrame, keys: Sequence[str]) -> DataFrame:
    """chains whose unknown ones are infinite where (keys, root) is a row of running: members that hold what never ends."""
    marked = running.select(*keys, "root").distinct().withColumn("_runs", F.lit(True))
    upstream = F.when((F.col("upstream") == "unknown") & F.col("_runs"), "infinite").otherwise(F.col("upstream"))
    return chains.join(marked, [*keys, "root"], "left").withColumn("upstream", upstream).drop("_runs")


def escapes(stored: DataFrame, references: DataFrame, context: Sequence[str], name: str = "name", consumption: str = "consumption") -> DataFrame:
    """stored, whose local_only results are local_escaping where their context refers to the local's name at least once.

    A null name or context is never referred to. References shrink to one row a name and context before they
    shuffle, so a context with many of them meets the join as its distinct names.
    """
    used = references.select(*context, name).na.drop().distinct().withColumn("_used", F.lit(True))
    out = F.when((F.col(consumption) == "local_only") & F.col("_used"), "local_escaping").otherwise(F.col(consumption))
    return stored.join(used, [*context, name], "left").withColumn(consumption, out).drop("_used")
