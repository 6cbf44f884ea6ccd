"""Rules as columns: predicates over nested facts, evaluated in one scan for all rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reachable_release(sites: Column, kind: str) -> Column:
    """Some release site of the kind lies outside a deinitializer."""
    return F.coalesce(F.exists(sites, lambda s: (s["kind"] == kind) & ~s["in_deinit"]), F.lit(False))


def deinit_only_release(sites: Column, kind: str) -> Column:
    """There are release sites of the kind, and all lie in deinitializers."""
    own = F.filter(sites, lambda s: s["kind"] == kind)
    return F.coalesce((F.size(own) > 0) & F.forall(own, lambda s: s["in_deinit"]), F.lit(False))


@dataclass(frozen=True)
class TableRule:
    """A rule over the rows of a table: when it holds, and its default severity."""

    id: str
    when: Column
    severity: str = "warning"
    enabled: bool = True


def evaluate(rows: DataFrame, rules: list[TableRule], keep: list[str], overrides: dict[str, dict] | None = None) -> DataFrame:
    """(rule, severity, *keep): one row for each rule that holds; rows are read once.

    overrides: {rule: {"enabled": ..., "severity": ...}}; a rule that is off leaves no trace in the plan.
    """
    overrides = overrides or {}
    if unknown := set(overrides) - {r.id for r in rules}:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    active = [(r, overrides.get(r.id, {})) for r in rules if overrides.get(r.id, {}).get("enabled", r.enabled)]
    found = F.array(*[F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.id).alias("rule"), F.lit(o.get("severity", r.severity)).alias("severity"))) for r, o in active])
    if not active:
        return rows.select(F.lit("").alias("rule"), F.lit("").alias("severity"), *keep).limit(0)
    return rows.withColumn("_found", F.explode(F.array_compact(found))).select("_found.rule", "_found.severity", *keep)
