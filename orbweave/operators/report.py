"""Reports of findings: lines, JSON, SARIF, a summary, and an exit status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.hashing import finding_fingerprint
from orbweave.operators.rank import numbered

SEVERITY_RANK = {"warning": 1, "error": 2}
#: The order of findings in a report; what follows the rule only settles ties.
ORDER = ("path", "line", "col", "rule", "message", "severity")


def fingerprint() -> Column:
    return finding_fingerprint(F.col("rule"), F.col("path"), F.col("line"), F.col("col"), F.col("message"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "col", "rule")


def text_lines(findings: DataFrame) -> DataFrame:
    """path:line:col: severity: [rule] message, and the note behind a dash."""
    line = F.format_string("%s:%d:%d: %s: [%s] %s", "path", "line", "col", "severity", "rule", "message")
    return ordered(findings).select(F.concat(line, F.coalesce(F.concat(F.lit(" - "), "note"), F.lit(""))).alias("value"))


def finding_json(findings: DataFrame) -> DataFrame:
    """One JSON object a finding, keys in alphabetical order."""
    return findings.select(F.to_json(F.struct(
        F.col("col").alias("column"), fingerprint().alias("fingerprint"), "line", "message", "note", "path", "rule", "severity")).alias("value"))


def _sarif_result() -> Column:
    location = F.struct(F.struct(
        F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))
    return F.struct(
        F.col("rule").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.concat_ws(" - ", "message", "note").alias("text")).alias("message"),
        F.array(location).alias("locations"), F.struct(fingerprint().alias("primary")).alias("partialFingerprints"))


def _sarif_tool(rules: list[tuple[str, str]], name: str) -> Column:
    described = F.array(*[F.struct(F.lit(i).alias("id"), F.struct(F.lit(s).alias("text")).alias("shortDescription")) for i, s in rules])
    return F.struct(F.struct(F.lit(name).alias("name"), described.alias("rules")).alias("driver"))


def sarif(findings: DataFrame, rules: list[tuple[str, str]], name: str = "orbweave") -> DataFrame:
    """(path, value): a SARIF 2.1.0 document for each path with findings, with the run's rules and its results in order.

    A document holds the findings of one path, so no task ever gathers those of a whole run.
    """
    order = F.struct("line", "col", "rule", "message", "severity")
    results = (findings.select("path", F.struct(order.alias("order"), _sarif_result().alias("result")).alias("r")).groupBy("path")
               .agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["result"]).alias("results")))
    run = F.struct(_sarif_tool(rules, name).alias("tool"), F.col("results"))
    return results.select("path", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def sarif_run(findings: DataFrame, rules: list[tuple[str, str]], name: str = "orbweave") -> DataFrame:
    """(part, value): one SARIF 2.1.0 document with one run; its values in order of part, one after the other, are its text.

    Part 0 opens the document and lists the rules once, the last part closes it, and each part between is a
    finding. Places come from sorted ranges, so no task sees all findings. Without findings there are two parts.
    """
    spark = findings.sparkSession
    placed = numbered(findings, ORDER, "part").select("part", _sarif_result().alias("r"))
    comma = F.when(F.col("part") > 1, ",").otherwise("")
    one = spark.range(1, numPartitions=1)
    head = one.select(F.lit(0).cast("long").alias("part"), F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":'), F.to_json(_sarif_tool(rules, name)), F.lit(',"results":[')).alias("value"))
    tail = placed.agg((F.count(F.lit(1)) + 1).alias("part")).select("part", F.lit("]}]}").alias("value"))
    return head.unionAll(placed.select("part", F.concat(comma, F.to_json("r")).alias("value"))).unionAll(tail)


def write_sarif_run(parts: DataFrame, folder: str) -> None:
    """Write the parts as text files whose lines, in order of the files' names, are the document."""
    parts.orderBy("part").select("value").write.mode("overwrite").text(folder)


def summary(findings: DataFrame) -> DataFrame:
    """errors and warnings."""
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def full_summary(findings: DataFrame, suppressed: DataFrame, files: DataFrame, baselined: DataFrame, probed: DataFrame) -> DataFrame:
    """One row: errors, warnings, suppressed, files, degraded (files with a detail), baselined, cache_hits, cache_misses."""
    kind = lambda df, c: df.select(c.alias("kind"))
    every = (kind(findings, F.col("severity")).unionAll(kind(suppressed, F.lit("suppressed"))).unionAll(kind(baselined, F.lit("baselined")))
             .unionAll(kind(files, F.when(F.col("detail").isNull(), "read").otherwise("degraded"))).unionAll(kind(probed, F.when(F.col("hit"), "hit").otherwise("miss"))))
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return every.agg(count("error").alias("errors"), count("warning").alias("warnings"), count("suppressed").alias("suppressed"), count("read", "degraded").alias("files"),
                     count("degraded").alias("degraded"), count("baselined").alias("baselined"), count("hit").alias("cache_hits"), count("miss").alias("cache_misses"))


def report_lines(findings: DataFrame, degraded: DataFrame) -> DataFrame:
    """The lines of the findings, and one for each degraded file (path, detail) that was skipped."""
    skipped = degraded.select(F.concat(F.col("path"), F.lit(":1:1: warning: file skipped: "), F.col("detail")).alias("value"))
    return text_lines(findings).unionAll(skipped)


def exit_status(findings: DataFrame, strict: bool = False) -> int:
    """1 if there is an error, or, if strict, any finding."""
    failing = findings if strict else findings.filter("severity = 'error'")
    return int(not failing.isEmpty())
