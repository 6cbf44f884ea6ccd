"""The configuration: a small JSON document, read whole or refused."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from orbweave.operators.lifetime_rules import GRAPH_RULE, RULES

MOST_BYTES = 1 << 20
KNOWN = {r.id for r in RULES} | {GRAPH_RULE[0]}
SEVERITIES = {"warning", "error"}


class ConfigError(ValueError):
    """The configuration can't be used; nothing runs with a part of it."""


@dataclass(frozen=True)
class Config:
    rules: dict[str, dict] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    contracts: tuple[dict, ...] = ()


def parse(text: str) -> Config:
    """The configuration in a JSON text; ConfigError where any part of it is not as it must be."""
    if len(text.encode()) > MOST_BYTES:
        raise ConfigError("longer than 1 MiB")
    try:
        data = json.loads(text)
    except ValueError as error:
        raise ConfigError(f"no JSON: {error}") from error
    if not isinstance(data, dict) or set(data) - {"rules", "exclude", "contracts"}:
        raise ConfigError("an object with rules, exclude and contracts is expected")
    rules, exclude, contracts = data.get("rules", {}), data.get("exclude", []), data.get("contracts", [])
    if not isinstance(rules, dict) or set(rules) - KNOWN:
        raise ConfigError(f"unknown rules: {sorted(set(rules) - KNOWN) if isinstance(rules, dict) else rules}")
    for name, own in rules.items():
        if not isinstance(own, dict) or set(own) - {"enabled", "severity"} or not isinstance(own.get("enabled", True), bool) or own.get("severity", "error") not in SEVERITIES:
            raise ConfigError(f"settings of {name}: {own}")
    if not isinstance(exclude, list) or not all(isinstance(x, str) for x in exclude):
        raise ConfigError("exclude must be strings")
    if not isinstance(contracts, list) or not all(isinstance(c, dict) and isinstance(c.get("callee"), str) and c["callee"] for c in contracts):
        raise ConfigError("each contract needs a callee")
    return Config(rules, tuple(exclude), tuple(contracts))


def load(spark: SparkSession, path: str) -> Config:
    """The configuration in a file that Spark can read; a longer one is refused before it is read."""
    file = spark.read.format("binaryFile").load(path)
    size = file.select("length").first()
    if size is None or size[0] > MOST_BYTES:
        raise ConfigError(f"{path} is missing or longer than 1 MiB")
    try:
        return parse(bytes(file.select("content").first()[0]).decode())
    except UnicodeDecodeError as error:
        raise ConfigError(f"{path} is not UTF-8") from error


def as_rows(spark: SparkSession, config: Config) -> DataFrame:
    """(rule, set_enabled, set_severity): what the configuration says about rules."""
    return spark.createDataFrame([(r, own.get("enabled"), own.get("severity")) for r, own in config.rules.items()], "rule string, set_enabled boolean, set_severity string")
