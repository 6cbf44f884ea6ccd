"""The facts cache: facts by path and content fingerprint, in snapshots behind a manifest.

A snapshot is a Parquet folder that nobody reads until the manifest, a small file that is put in place in one
step, names it. So a writer that dies halfway leaves the last snapshot as it was. The manifest also holds
how many entries there are and a digest of their keys, so a run that would write the same entries writes
nothing. The snapshot before the current one stays for those who read it; older ones go. A cache is only there to
save work: whatever is wrong with it, reading gives an empty table and writing gives False.
"""

from __future__ import annotations

import json
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators.store import remove

MANIFEST = "current.json"


def salt(defines: list[str], contracts: list[str]) -> str:
    """What a content key holds beside the content: settings that change the facts, in order."""
    return ",".join(sorted(defines)) + ";" + ",".join(sorted(contracts)) + ";"


def probe(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """files (path, fingerprint, ...) with hit and the cached facts (null on a miss)."""
    known = snapshot.select("path", "fingerprint", F.col("facts"), F.lit(True).alias("hit"))
    return files.join(known, ["path", "fingerprint"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _manifest(spark: SparkSession, path: str) -> dict:
    """The manifest at path; empty if there is none that can be read."""
    try:
        found = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{MANIFEST}").collect()))
        return found if {"snapshot", "entries", "digest"} <= set(found) else {}
    except (PySparkException, Py4JJavaError, ValueError, TypeError):
        return {}


def _put_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write the manifest beside the old one and rename it over that, which Hadoop's file systems do in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    new, at = fs.Path(f"{path}/.{uuid.uuid4().hex}.json"), fs.Path(f"{path}/{MANIFEST}")
    out = new.getFileSystem(conf).create(new, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    over[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(new.toUri(), conf).rename(new, at, over)


def load(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """The cached rows of this version; an empty table where the cache is missing or unreadable."""
    try:
        rows = spark.read.schema(schema).parquet(f"{path}/{_manifest(spark, path)['snapshot']}")
        rows.limit(1).collect()
        return rows.filter(F.col("version") == version)
    except (PySparkException, Py4JJavaError, KeyError):
        return spark.createDataFrame([], schema)


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """The names of the snapshots at path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(s.getPath().getName() for s in found if s.isDirectory() and s.getPath().getName().startswith("snapshot-"))


def store(rows: DataFrame, path: str) -> bool:
    """Replace the cache by the rows (path, fingerprint, version, ...) of this run, which drops files that are gone.

    Whether anything was written: not if the entries are the same as those that are there, or if it failed.
    """
    spark = rows.sparkSession
    key = F.xxhash64("path", "fingerprint", "version").cast("decimal(38,0)")
    try:
        before = _manifest(spark, path)
        count, digest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(key), F.lit(0).cast("decimal(38,0)"))).first()
        now = {"snapshot": f"snapshot-{uuid.uuid4().hex}", "entries": count, "digest": str(digest)}
        if before and (before["entries"], before["digest"]) == (now["entries"], now["digest"]) and before["snapshot"] in snapshots(spark, path):
            return False
        rows.write.parquet(f"{path}/{now['snapshot']}")
        _put_manifest(spark, path, now)
        for name in snapshots(spark, path):
            if name not in (now["snapshot"], before.get("snapshot")):
                remove(spark, f"{path}/{name}")
        return True
    except (PySparkException, Py4JJavaError) as error:
        warnings.warn(f"the cache at {path} was not written: {error}", stacklevel=2)
        return False
