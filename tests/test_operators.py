"""Generic operators on small tables, beside results worked out by hand or by plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from orbweave.functions.hashing import fnv1a_hex
from orbweave.functions.vectors import cosine, mean_pool
from orbweave.operators.graph import component_cycles, first_edges, reachable, resolve_references, strong_components
from orbweave.operators.joins import asof_latest, band_join, first_match, split_known
from orbweave.operators.rank import leader_clusters
from orbweave.operators.report import exit_status, finding_json, summary, text_lines
from orbweave.operators.suppression import suppress
from orbweave.sources.cache import load, probe, store
from orbweave.sources.files import admit, discover
from orbweave.streaming.doc_state import current, follow


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_asof_takes_the_latest_row_that_is_not_later(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9)], "id int, k string, at int")
    right = spark.createDataFrame([("a", 2, 0, "x"), ("a", 5, 1, "y"), ("a", 5, 0, "w"), ("b", 10, 0, "z")], "k string, at int, ord int, v string")
    got = {r.id: r.v for r in asof_latest(left, right, ["k"], "at", ["ord"], ["v"]).collect()}
    assert got == {1: "y", 2: None, 3: None, 4: None}
    assert asof_latest(left.limit(0), right, ["k"], "at", ["ord"], ["v"]).count() == 0


def test_band_join_agrees_with_all_pairs(spark):
    rng = random.Random(1)
    a = [(rng.choice("xy"), rng.randint(-20, 20)) for _ in range(60)]
    b = [(rng.choice("xy"), rng.randint(-20, 20)) for _ in range(60)]
    got = rows(band_join(spark.createDataFrame(a, "k string, p int"), spark.createDataFrame(b, "k string, q int"), ["k"], "p", "q", 3).select("k", "p", "q"))
    assert got == sorted((k, p, q) for (k, p), (j, q) in itertools.product(a, b) if k == j and abs(p - q) <= 3)


def test_first_match_needs_base_and_labels(spark):
    calls = spark.createDataFrame([(1, "f", "B", ["x", "y"]), (2, "f", None, []), (3, "g", "B", ["x"])], "id int, callee string, base string, labels array<string>")
    contracts = spark.createDataFrame([(0, "f", "B", ["z"], "no"), (1, "f", "B", ["x"], "yes"), (2, "f", None, [], "any")], "ord int, callee string, base string, required array<string>, template string")
    assert rows(first_match(calls, contracts, "id")) == [(1, 1, "yes"), (2, 2, "any")]


def test_split_known(spark):
    new, known = split_known(spark.createDataFrame([("a",), ("b",), ("b",)], "f string"), spark.createDataFrame([("b",), ("b",)], "f string"), "f")
    assert rows(new) == [("a",)] and rows(known) == [("b",), ("b",)]


def test_graph(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    refs = spark.createDataFrame([("a", "b", 2), ("a", "b", 1), ("b", "c", 3), ("c", "c", 4), ("c", "zz", 5)], "src string, dst string, line int")
    edges, unknown = resolve_references(refs, nodes)
    assert rows(edges.select("src", "dst", "line")) == [("a", "b", 1), ("a", "b", 2), ("b", "c", 3)]
    assert rows(unknown.select("src", "dst")) == [("c", "zz")]
    assert rows(first_edges(edges, ["line"])) == [("a", "b", 1), ("b", "c", 3)]
    assert rows(reachable(edges, nodes.filter("name = 'a'"))) == [("a", 0), ("b", 1), ("c", 2)]


def test_components_agree_with_reachability(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)} | {(1, 1), (20, 21), (21, 20)}
    reach = {i: {j for i_, j in pairs if i_ == i} for i in range(22)}
    for _ in range(22):
        for i in reach:
            reach[i] |= {k for j in reach[i] for k in reach[j]}
    want = {}
    for i in reach:
        mates = {j for j in reach[i] if i in reach[j]} | {i}
        if len(mates) > 1:
            want[i] = min(mates)
    edges = spark.createDataFrame(list(pairs), "src long, dst long")
    found = strong_components(edges)
    assert dict(rows(found)) == want
    real = {(i, j) for i, j in pairs if i != j}
    cycles = rows(component_cycles(edges, found))
    assert [c for c, _ in cycles] == sorted(set(want.values()))
    for start, path in cycles:
        assert path[0] == start and all(step in real for step in zip(path, [*path[1:], start], strict=True))


def test_suppression(spark):
    findings = spark.createDataFrame([("p", 3, "r1"), ("p", 4, "r1"), ("p", 9, "r1"), ("p", 9, "r2"), ("q", 3, "r1")], "path string, line int, rule string")
    directives = spark.createDataFrame(
        [("p", 0, 2, "disable", ["r1"], None), ("p", 1, 3, "accept:next", [], "known"), ("p", 2, 5, "enable", [], None), ("p", 3, 8, "disable", ["r2"], None)],
        "path string, ord int, line int, kind string, rules array<string>, reason string")
    got = suppress(findings, directives, ["r1", "r2"]).select("path", "line", "rule", "status", "accept_reason")
    assert {tuple(r) for r in got.collect()} == {
        ("p", 3, "r1", "region", None), ("p", 4, "r1", "accepted", "known"), ("p", 9, "r1", "kept", None), ("p", 9, "r2", "region", None), ("q", 3, "r1", "kept", None)}


def test_fnv1a_matches_plain_python(spark):
    def plain(text):
        h = 0xCBF29CE484222325
        for byte in text.encode():
            h = (h ^ byte) * 0x100000001B3 % 2**64
        return f"{h:x}"

    texts = ["", "a", "foobar", "naïve ☃ 𝄞", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a_hex(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: plain(t) for t in texts}


def test_vectors_and_leaders(spark):
    data = [(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0]), (2, 1, [0.0, 0.0]), (2, 2, [])]
    df = spark.createDataFrame(data, "g long, i long, v array<double>")
    assert rows(mean_pool(df.filter("i < 3 and g = 1"), "g", "v")) == [(1, 0, 0.95), (1, 1, 0.05)]
    assert [round(r[0], 3) for r in df.orderBy("g", "i").select(cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0)))).collect()] == [1.0, 0.994, 0.0, 0.0, 0.0]
    assert rows(leader_clusters(df, "g", "i", "v"))[:3] == [(1, 1, 1), (1, 2, 1), (1, 3, 3)]


def test_reports(spark):
    findings = spark.createDataFrame([("r", "error", "b", 1, 2, "m", None), ("r", "warning", "a", 3, 4, "m", "n")], "rule string, severity string, path string, line int, col int, message string, note string")
    assert [r.value for r in text_lines(findings).collect()] == ["a:3:4: warning: [r] m - n", "b:1:2: error: [r] m"]
    assert rows(summary(findings)) == [(1, 1)]
    assert exit_status(findings) == 1 and exit_status(findings.filter("path = 'a'")) == 0 and exit_status(findings.filter("path = 'a'"), strict=True) == 1
    assert all(r.value.startswith('{"column":') for r in finding_json(findings).collect())


def test_files_and_cache(spark, tmp_path):
    (tmp_path / "src/.git").mkdir(parents=True)
    (tmp_path / "src/a.swift").write_text("class A {}")
    (tmp_path / "src/b.swift").write_bytes(b"\xff\xfe")
    (tmp_path / "src/big.swift").write_text("x" * 50)
    (tmp_path / "src/.git/c.swift").write_text("hidden")
    (tmp_path / "src/d.txt").write_text("other")
    sources, degraded = admit(discover(spark, [str(tmp_path / "src")]), most=20)
    assert [r.source for r in sources.collect()] == ["class A {}"] and degraded.count() == 2
    schema = "path string, fingerprint string, facts string, version string"
    assert load(spark, str(tmp_path / "none"), schema, "1").count() == 0
    store(spark.createDataFrame([("a", "f", "x", "1"), ("b", "f", "y", "0")], schema), str(tmp_path / "cache"))
    files = spark.createDataFrame([("a", "f"), ("a", "other"), ("b", "f")], "path string, fingerprint string")
    assert rows(probe(files, load(spark, str(tmp_path / "cache"), schema, "1")).filter("hit").select("path", "facts")) == [("a", "x")]


def test_stream_keeps_the_latest_event_over_restarts(spark, tmp_path):
    schema = "k long, at long, v string"
    told = (["at"], ["v"])

    def more(data):
        spark.createDataFrame(data, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        follow(stream, "k", *told, str(tmp_path / "log"), str(tmp_path / "progress")).awaitTermination()
        return rows(current(spark, str(tmp_path / "log"), "k", *told))

    assert more([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")]) == [(1, 3, "c"), (2, 1, "x")]
    assert more([(1, 2, "b"), (2, 5, "y"), (3, 1, "n")]) == [(1, 3, "c"), (2, 5, "y"), (3, 1, "n")]
