"""The baseline: fingerprints of known findings, as sorted lines of JSON that each carry the version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


class BaselineError(ValueError):
    """The baseline is of another version or damaged; it is not used in part."""


def write(fingerprints: DataFrame, path: str) -> None:
    """Distinct fingerprints in order, over as many files as they need."""
    fingerprints.select("fingerprint").distinct().sort("fingerprint").select(F.lit(VERSION).alias("version"), "fingerprint").write.json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint) of a baseline; BaselineError unless every line has this version and a fingerprint."""
    rows = spark.read.schema("version int, fingerprint string").json(path)
    if not rows.filter(f"version is null or version <> {VERSION} or fingerprint is null").isEmpty():
        raise BaselineError(f"{path} is damaged or not of version {VERSION}")
    return rows.select("fingerprint")
