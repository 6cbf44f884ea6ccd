"""Directives of every shape, types that several files speak of, and the gate on a stale index."""

import datetime

import pytest

from orbweave.operators.suppression import suppress
from orbweave.operators.types import merge_types
from orbweave.sources.directives import directives_of, parse
from orbweave.sources.files import admit, discover, gated, listing, stale_files

RULES = ("timer", "sink", "closure")


@pytest.mark.parametrize(("comment", "found"), [
    ("// @ow:accept:this closure, timer -- managed elsewhere", ("accept:this", ["closure", "timer"], "managed elsewhere")),
    ("// @ow:accept -- torn down in close()", ("accept", [], "torn down in close()")),
    ("// @orbweave:accept:next", ("accept:next", [], None)), ("// @ow:accept:next", ("accept:next", [], None)),
    ("// @ow:disable all", ("disable", [], None)), ("/* @ow:enable timer,sink timer*/", ("enable", ["sink", "timer"], None)),
    ("// @ow:accept timer,all", ("accept", [], None)), ("// @ow:accept timer,later-rule --", ("accept", ["timer"], "")),
    ("@ow:disable\ttimer\t--a--b", ("disable", ["timer"], "a--b")), ("// @ow: accept", ("accept", [], None)),
    ("// regular comment", None), ("// #ow:expect timer", None), ("// ow:accept", None), ("// @ow:accept:this not-a-rule", None), ("// @ow:allow timer", None),
    ("// @other:accept", None), ("  // @ow:accept", None), ("// @ow:", None), ("// @ow:-- accept", None), ("", None), (None, None), ("//", None),
])
def test_shapes(comment, found):
    assert parse(comment, RULES) == found


def test_table_function_feeds_suppression(spark):
    comments = spark.createDataFrame([
        ("f", 1, "// @ow:disable timer"), ("f", 5, "// @ow:accept sink -- meant"), ("f", 9, "// @ow:enable timer"), ("f", 7, "// nothing"), ("f", 8, None),
        ("g", 1, "// @ow:disable"), ("g", 3, "// @ow:accept:this nothing-known")], "path string, line int, comment string")
    found = directives_of(comments, "comment", RULES)
    assert found.columns == ["path", "line", "comment", "kind", "rules", "reason"] and found.count() == 4
    findings = spark.createDataFrame([("f", n, r) for n in (2, 5, 6, 7, 10) for r in ("timer", "sink")] + [("g", 99, "closure"), ("h", 1, "sink")], "path string, line int, rule string")
    directives = found.select("path", "line", "kind", "rules", "reason", found.line.alias("ord"))
    got = {(r.path, r.line, r.rule): (r.status, r.accept_reason) for r in suppress(findings, directives, list(RULES)).collect()}
    assert {k for k, v in got.items() if v[0] == "region"} == {("f", 2, "timer"), ("f", 5, "timer"), ("f", 6, "timer"), ("f", 7, "timer"), ("g", 99, "closure")}
    assert {k: v[1] for k, v in got.items() if v[0] == "accepted"} == {("f", 5, "sink"): "meant", ("f", 6, "sink"): "meant"}


def test_types_of_one_name_in_several_files(spark):
    rows = [
        ("a", "Hub", True, ["x", "y"], ["NSObject"], None), ("b", "Hub", None, ["y", "z", None], [], ["Model"]), ("b", "Hub", None, ["z"], [], ["Model"]),
        ("a", "Value", False, [], None, None), ("c", "Value", None, ["v"], ["Equatable"], []), ("a", "Open", None, None, None, None), ("a", None, True, ["q"], [], []), (None, "Open", None, [], [], [])]
    types = spark.createDataFrame(rows, "path string, name string, is_reference boolean, members array<string>, inherited array<string>, attributes array<string>")
    got = {r.name: tuple(r)[1:] for r in merge_types(types).collect()}
    assert got == {"Hub": (True, 2, ["x", "y", "z"], ["NSObject"], ["Model"]), "Value": (False, 2, ["v"], ["Equatable"], []), "Open": (None, 1, [], [], [])}
    assert merge_types(types.limit(0)).count() == 0


def test_one_stale_file_switches_the_index_off(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.swift").write_text(f"class {name} {{}}")
    files = listing(spark, [str(tmp_path)])
    assert "content" not in files.columns and files.count() == 3
    later, earlier = datetime.datetime(2100, 1, 1), datetime.datetime(2000, 1, 1)
    paths = sorted(r.path for r in files.collect())
    units = lambda *seen: spark.createDataFrame([(p, t) for p, t in zip(paths, seen)], "path string, seen timestamp")
    index = spark.createDataFrame([("A",), ("B",)], "name string")
    assert gated(index, stale_files(files, units(later, later, later))).count() == 2
    stale = stale_files(files, units(later, earlier, later))
    assert [r.path for r in stale.collect()] == [paths[1]] and gated(index, stale).count() == 0
    assert stale_files(files, units(later, later)).count() == 1  # the index does not know the third
    assert stale_files(files, units(later, earlier, later).unionByName(units(later, later, later))).count() == 0  # the latest look counts


def test_the_bound_on_size_reaches_the_scan(spark, tmp_path, capsys):
    (tmp_path / "a.swift").write_text("class A {}")
    (tmp_path / "big.swift").write_text("x" * 100)
    sources, degraded = admit(discover(spark, [str(tmp_path)]), most=50)
    assert [r.source for r in sources.collect()] == ["class A {}"] and degraded.count() == 1
    sources.explain()
    assert "LessThanOrEqual(length,50)" in capsys.readouterr().out
