"""Suppression of findings by directives: accepts on a line, and regions that are switched off and on.

An accept beats any region, whatever their order. Without one, the latest region directive at or
before the finding's line that covers its rule decides; an empty list of rules covers all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.joins import asof_latest

#: How far below its own line an accept reaches.
ACCEPT_OFFSETS = {"accept:this": (0,), "accept:next": (1,), "accept": (0, 1)}


def accepted(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """findings with accepted (boolean) and accept_reason, that of the first directive that applies."""
    offsets = F.create_map(*[x for kind, reach in ACCEPT_OFFSETS.items() for x in (F.lit(kind), F.array(*[F.lit(r) for r in reach]))])
    targets = (directives.filter(F.col("kind").isin(*ACCEPT_OFFSETS)).select(
        F.col("path").alias("_path"), "ord", "rules", "reason", "line", F.explode(offsets[F.col("kind")]).alias("_reach"))
        .withColumn("_line", F.col("line") + F.col("_reach")).drop("line", "_reach"))
    covers = (F.size("rules") == 0) | F.array_contains("rules", F.col("rule"))
    keys = ["path", "line", "rule"]
    hits = (findings.select(*keys).distinct().join(targets, (F.col("path") == F.col("_path")) & (F.col("line") == F.col("_line")) & covers)
            .groupBy(*keys).agg(F.min_by("reason", "ord").alias("accept_reason"), F.lit(True).alias("accepted")))
    return findings.join(hits, keys, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def in_region(findings: DataFrame, directives: DataFrame, rules: list[str]) -> DataFrame:
    """findings with region, the kind of the latest region directive that covers them (or null)."""
    every = F.array(*[F.lit(r) for r in rules])
    switches = (directives.filter(F.col("kind").isin("disable", "enable"))
                .withColumn("rule", F.explode(F.when(F.size("rules") == 0, every).otherwise(F.col("rules")))).select("path", "rule", "line", "ord", F.col("kind").alias("region")))
    return asof_latest(findings, switches, ["path", "rule"], "line", ["ord"], ["region"])


def suppress(findings: DataFrame, directives: DataFrame, rules: list[str]) -> DataFrame:
    """findings with status: accepted, region or kept; and accept_reason."""
    judged = accepted(in_region(findings, directives, rules), directives)
    return judged.withColumn("status", F.when(F.col("accepted"), "accepted").when(F.col("region") == "disable", "region").otherwise("kept")).drop("accepted", "region")
