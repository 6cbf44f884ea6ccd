"""Receiver chains, locals that escape and the SARIF run against plain Python."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orbweave.operators import chains, lifetime_rules, report

LINK = "chain long, at int, name string, is_member boolean"


def plain_class(links):
    names = {n for _, n, _ in links if n is not None}
    roots = [n for _, n, m in sorted(links, key=lambda x: x[0]) if m and n is not None]
    if names & set(chains.FINITE):
        kind = "finite"
    elif names & {*chains.INFINITE, *chains.SUBJECTS} or any(n.startswith("$") for n in names) or set(chains.CENTER) <= names:
        kind = "infinite"
    else:
        kind = "unknown"
    return kind, roots[-1] if roots else None


def test_classes_of_chains(spark):
    rng = random.Random(5)
    names = ["map", "items", "$items", "filter", "", None, "publisher", "NotificationCenter", "publish", "first", "Just", "CurrentValueSubject", "publisher", "sink"]
    made = {c: [(k, rng.choice(names), rng.choice([True, False, None])) for k in range(rng.randint(1, 4))] for c in range(300)}
    rows = [(c, *link) for c, links in made.items() for link in links]
    got = {r.chain: (r.upstream, r.root) for r in chains.classify(spark.createDataFrame(rows, LINK), ["chain"], F.col("at")).collect()}
    assert got == {c: plain_class(links) for c, links in made.items()}
    assert {k for k, _ in got.values()} == {"finite", "infinite", "unknown"}


@pytest.mark.parametrize("links, upstream", [
    (["first", "publish"], "finite"), (["publisher"], "unknown"), (["publisher", "NotificationCenter"], "infinite"), (["a$b"], "unknown"), ([None], "unknown"), ([""], "unknown"),
])
def test_single_chains(spark, links, upstream):
    rows = spark.createDataFrame([(1, k, n, False) for k, n in enumerate(links)], LINK)
    assert [tuple(r) for r in chains.classify(rows, ["chain"], F.col("at")).collect()] == [(1, upstream, None)]


def test_roots_are_resolved_in_their_own_type(spark):
    found = spark.createDataFrame([(1, "A", "unknown", "m"), (2, "B", "unknown", "m"), (3, "A", "finite", "m"), (4, "A", "unknown", None), (5, None, "unknown", "m")], "chain int, type string, upstream string, root string")
    running = spark.createDataFrame([("A", "m"), ("A", "m"), ("A", None), (None, "m")], "type string, root string")
    got = {r.chain: r.upstream for r in chains.resolve_roots(found, running, ["type"]).collect()}
    assert got == {1: "infinite", 2: "unknown", 3: "finite", 4: "unknown", 5: "unknown"}


def test_escapes(spark):
    stored = spark.createDataFrame([(1, "x", "local_only"), (1, "x", "local_only"), (1, "y", "local_only"), (2, "x", "local_only"), (1, "z", "returned"), (None, "x", "local_only"), (1, None, "local_only")],
                                   "method int, name string, consumption string")
    used = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "z", 3), (None, "x", 4), (1, None, 5)], "method int, name string, consumption int")
    got = sorted((str(r.method), str(r.name), r.consumption) for r in chains.escapes(stored, used, ["method"]).collect())
    assert got == [("1", "None", "local_only"), ("1", "x", "local_escaping"), ("1", "x", "local_escaping"), ("1", "y", "local_only"), ("1", "z", "returned"), ("2", "x", "local_only"), ("None", "x", "local_only")]
    assert chains.escapes(stored.limit(0), used, ["method"]).count() == 0


FINDING = "path string, line int, col int, rule string, severity string, message string, note string"


@pytest.mark.parametrize("count", [0, 1, 300])
def test_sarif_run_is_one_document(spark, tmp_path, count):
    rng = random.Random(count)
    rows = [(f"p{rng.randint(0, 4)}", rng.randint(1, 9), 1, rng.choice(["a", "b"]), "error", 'said "no"\n]', None if k % 2 else "note") for k in range(count)]
    report.write_sarif_run(report.sarif_run(spark.createDataFrame(rows, FINDING), [("a", "first"), ("b", "second")]), str(tmp_path / "run"))
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "run").glob("part-*")))
    run, = json.loads(text)["runs"]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["a", "b"]
    at = [r["locations"][0]["physicalLocation"] for r in run["results"]]
    got = [(x["artifactLocation"]["uri"], x["region"]["startLine"], x["region"]["startColumn"], r["ruleId"]) for x, r in zip(at, run["results"], strict=True)]
    assert got == sorted(r[:4] for r in rows)


def test_only_the_rules_asked_for(spark):
    with pytest.raises(ValueError, match="unknown rules"):
        lifetime_rules.check_types(spark.range(0), only=["no-such-rule"])
