"""Source files as a DataFrame: discovery, exclusion, a bound on size, and a UTF-8 check.

Only paths and sizes are looked at before a file is admitted: the filters on path and length reach the
scan, and the content of files that are left out is never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest source that is analysed, in bytes.
MOST_BYTES = 10 * 1024 * 1024
#: Directories of builds and version control, left out of walks.
PRUNED = (".build", ".git", "DerivedData", "Pods", "Carthage")


def not_excluded(path: Column, excludes: Sequence[str]) -> Column:
    """Whether a path contains none of the (non-empty) substrings."""
    found = F.lit(False)
    for part in excludes:
        if part:
            found = found | F.contains(path, F.lit(part))
    return ~found


def discover(spark: SparkSession, paths: Sequence[str], excludes: Sequence[str] = ()) -> DataFrame:
    """(path, length, content) of the Swift files below paths; explicit files pass unfiltered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.swift").load(list(paths))
    hidden = F.regexp_like(F.col("path"), F.lit(r"/\.[^/]+")) | F.regexp_like(F.col("path"), F.lit("/(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/"))
    return files.filter(~hidden & not_excluded(F.col("path"), excludes)).select("path", "length", "content")


def admit(files: DataFrame, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(sources (path, source), degraded (path, reason)): too large or not UTF-8 is degraded."""
    small = files.filter(F.col("length") <= most)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    sources = small.filter(valid).select("path", F.col("content").cast("string").alias("source"))
    degraded = files.filter(F.col("length") > most).select("path", F.lit("larger than the limit").alias("reason")).unionByName(
        small.filter(~valid).select("path", F.lit("not valid UTF-8").alias("reason")))
    return sources, degraded


def from_memory(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """(path, source) of texts at hand."""
    return spark.createDataFrame(list(sources), "path string, source string")


def listing(spark: SparkSession, paths: Sequence[str], pattern: str = "*.swift") -> DataFrame:
    """(path, length, modified) of files, without a look at their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(paths))
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def stale_files(files: DataFrame, units: DataFrame) -> DataFrame:
    """(path) of files (path, modified) that an index does not know, or that changed after it looked at them.

    units (path, seen) may have several rows a path, of which the latest counts; a file whose time is unknown is stale.
    """
    latest = units.groupBy("path").agg(F.max("seen").alias("seen"))
    known = F.coalesce(F.col("modified") <= F.col("seen"), F.lit(False))
    return files.join(latest, "path", "left").filter(~known).select("path").distinct()


def gated(index: DataFrame, stale: DataFrame) -> DataFrame:
    """The index if nothing is stale, and otherwise none of it: facts of another state of the sources could be wrong."""
    return index if stale.isEmpty() else index.limit(0)
