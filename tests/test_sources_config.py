"""Configuration and baseline: read whole or refused; external types; report lines and summary."""

import pytest

from orbweave.operators import external, report
from orbweave.sources import baseline, config


@pytest.mark.parametrize("text", [
    "{", "[]", '{"rule": {}}', '{"rules": {"nonsense": {}}}', '{"rules": {"timer-retains-self": {"severity": "fatal"}}}', '{"rules": {"timer-retains-self": {"enabled": 1}}}',
    '{"exclude": [1]}', '{"contracts": [{"callee": ""}]}', '{"exclude": ["' + "x" * (1 << 20) + '"]}',
])
def test_config_is_refused(text):
    with pytest.raises(config.ConfigError):
        config.parse(text)


def test_config_file(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"rules": {"timer-retains-self": {"enabled": false}}, "exclude": ["/gen/"], "contracts": [{"callee": "watch"}]}')
    (tmp_path / "long.json").write_text(" " * ((1 << 20) + 1))
    (tmp_path / "odd.json").write_bytes(b"\xff\xfe")
    got = config.load(spark, str(tmp_path / "good.json"))
    assert got.rules == {"timer-retains-self": {"enabled": False}} and got.exclude == ("/gen/",)
    for name in ("long.json", "odd.json"):
        with pytest.raises(config.ConfigError):
            config.load(spark, str(tmp_path / name))


def test_baseline(spark, tmp_path):
    rows = spark.createDataFrame([("b",), ("a",), ("b",)], "fingerprint string")
    baseline.write(rows, str(tmp_path / "b"))
    assert sorted(r[0] for r in baseline.read(spark, str(tmp_path / "b")).collect()) == ["a", "b"]
    for k, line in enumerate(('{"version": 2, "fingerprint": "a"}', '{"fingerprint": "a"}', "no json", '{"version": 1}')):
        (tmp_path / f"bad{k}.json").write_text(f'{{"version": 1, "fingerprint": "x"}}\n{line}\n')
        with pytest.raises(baseline.BaselineError):
            baseline.read(spark, str(tmp_path / f"bad{k}.json"))


def test_external_types(spark):
    types = spark.createDataFrame([("A", None, ["P"]), ("B", True, None), ("C", None, None), ("D", False, ["Q"])], "name string, is_reference boolean, inherited array<string>")
    known = spark.createDataFrame([("A", True, ["P", "R"]), ("B", False, ["X"]), ("D", True, ["X"])], "name string, is_reference boolean, inherited array<string>")
    got = {r.name: (r.is_reference, r.inherited) for r in external.upgrade(types, known).collect()}
    assert got == {"A": (True, ["P", "R"]), "B": (True, None), "C": (None, None), "D": (False, ["Q"])}


def test_report(spark):
    found = spark.createDataFrame([("r", "error", "f", 2, 1, "m", None), ("r", "warning", "f", 1, 1, "m", "n")], "rule string, severity string, path string, line int, col int, message string, note string")
    files = spark.createDataFrame([("f", None), ("g", "not valid UTF-8")], "path string, detail string")
    assert [r[0] for r in report.report_lines(found, files.filter("detail is not null")).collect()] == ["f:1:1: warning: [r] m - n", "f:2:1: error: [r] m", "g:1:1: warning: file skipped: not valid UTF-8"]
    hits = spark.createDataFrame([(True,), (False,), (False,)], "hit boolean")
    assert tuple(report.full_summary(found, found.limit(1), files, found.limit(0), hits).first()) == (1, 1, 1, 2, 1, 0, 1, 2)
