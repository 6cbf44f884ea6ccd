"""Each rule on types made by hand: what fires, at which severity, and what keeps it silent."""

import pytest

from orbweave.operators.lifetime_rules import RULES, TYPE, catalog, check_types

STRONG, IMPLICIT, WEAK, UNOWNED = ("strong", None, False), ("strong", None, True), ("weak", None, None), ("unowned", None, None)


def tag(name, text=None, flag=None):
    return (name, text, flag)


def call(kind, repeats=None, target=False, receiver=False, upstream="unknown", capture=None, nested=False, used=("other", None, None), name=None, line=1):
    return ((kind, name, None), (line, 1), repeats, target, receiver, upstream, capture, nested, used)


def type_row(name, ref=True, members=(), inherited=(), dead=None, props=None, closures=None, calls=None, spawns=None, sites=None):
    return ("f", name, ref, list(members), list(inherited), [], dead, props, closures, calls, spawns, sites)


MEMBER, DROPPED = tag("self_member", "bag"), tag("discarded")
CASES = [
    # name, type, expected (rule, severity)
    ("closure", type_row("", closures=[((3, 4), "done", STRONG, False), ((5, 1), "other", WEAK, False), ((6, 1), "m", STRONG, True)]), [("stored-closure-strong-self", "error")] * 2),
    ("closure of a value type", type_row("", ref=False, closures=[((3, 4), "done", STRONG, False)]), []),
    ("closure of an unknown type", type_row("", ref=None, closures=[((3, 4), "done", STRONG, False)]), []),
    ("timer", type_row("", calls=[call("timer_target", target=True), call("timer_target", repeats=False, target=True), call("timer_block", capture=STRONG), call("display_link", target=True)]), [("timer-retains-self", "warning")] * 2),
    ("timer stopped", type_row("", calls=[call("timer_block", repeats=True, capture=STRONG)], sites=[("invalidate", False), ("invalidate", True)]), []),
    ("timer stopped in deinit", type_row("", calls=[call("timer_block", repeats=True, capture=STRONG)], sites=[("invalidate", True)]), [("timer-retains-self", "error")]),
    ("observer", type_row("", calls=[call("block_observer", capture=STRONG, used=DROPPED)], sites=[("removeObserver", True)]), [("notification-observer-leak", "error")]),
    ("observer dropped", type_row("", calls=[call("block_observer", capture=WEAK, used=DROPPED)]), [("unstored-lifetime-token", "warning")]),
    ("observer dropped by a lasting owner", type_row("", members=["shared"], calls=[call("block_observer", capture=WEAK, used=DROPPED)]), []),
    ("sink", type_row("", calls=[call("sink", upstream="infinite", capture=STRONG, used=MEMBER), call("user_sink", capture=STRONG, used=tag("store_in", None, True)), call("sink", upstream="finite", capture=STRONG, used=MEMBER)]),
     [("combine-sink-self-cycle", "error"), ("combine-sink-self-cycle", "warning")]),
    ("assign", type_row("", calls=[call("assign_on", target=True, upstream="infinite", used=MEMBER), call("assign_on", target=False, used=MEMBER)]), [("combine-assign-self-cycle", "error")]),
    ("task", type_row("", spawns=[((1, 1), IMPLICIT, True, MEMBER), ((2, 1), STRONG, True, DROPPED), ((3, 1), STRONG, False, MEMBER)]), [("task-nonterminating-self", "error"), ("task-nonterminating-self", "warning")]),
    ("task cancelled", type_row("", spawns=[((1, 1), STRONG, True, MEMBER)], sites=[("cancel", False)]), []),
    ("tokens", type_row("", ref=None, calls=[call("key_path_observer", used=tag("local_only", "x")), call("user_token", used=DROPPED, name="Token"), call("periodic_observer", used=tag("store_in", None, False)), call("sink", used=tag("store_in_captured_local", "y")), call("sink", used=tag("returned"))]),
     [("token-stored-in-local", "warning")] * 3 + [("unstored-lifetime-token", "warning")]),
    ("tokens of a test", type_row("", inherited=["XCTestCase"], calls=[call("user_token", used=DROPPED)]), []),
    ("session", type_row("", calls=[call("session_delegate", target=True)]), [("urlsession-delegate-leak", "warning")]),
    ("dispatch", type_row("", calls=[call("dispatch_handler", receiver=True, capture=STRONG), call("dispatch_handler", receiver=False, capture=STRONG)], sites=[("cancel", True)]), [("dispatch-source-cycle", "error")]),
    ("unowned", type_row("", calls=[call("timer_block", capture=UNOWNED), call("sink", capture=UNOWNED)]), [("unowned-outlives-owner", "warning")]),
    ("opt-in", type_row("", dead=[(9, 9)], props=[("viewDelegate", "strong", [], False, False, (1, 1)), ("x", "strong", ["TableDataSource"], False, None, (2, 1)), ("delegate", "weak", [], None, False, (3, 1))]), []),
]


def rows(spark):
    return spark.createDataFrame([(p, n, *rest) for n, (p, _, *rest), _ in CASES], TYPE)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.type, []).append((r.rule, r.severity))
    return {k: sorted(v) for k, v in out.items()}


def test_rules(spark):
    assert found(check_types(rows(spark))) == {n: sorted(e) for n, _, e in CASES if e}


def test_overrides(spark):
    got = found(check_types(rows(spark), {"dead-weak-capture": {"enabled": True}, "delegate-strong-property": {"enabled": True, "severity": "error"}, "combine-sink-self-cycle": {"severity": "warning"}, "timer-retains-self": {"enabled": False}}))
    assert got["opt-in"] == [("dead-weak-capture", "warning"), ("delegate-strong-property", "error"), ("delegate-strong-property", "error")]
    assert got["sink"] == [("combine-sink-self-cycle", "warning")] * 2 and "timer" not in got
    with pytest.raises(ValueError, match="unknown"):
        check_types(rows(spark), {"no-such-rule": {}})


def test_notes_name_and_catalog(spark):
    said = {(r.type, r.rule): r for r in check_types(rows(spark)).collect()}
    assert "deinit" in said["timer stopped in deinit", "timer-retains-self"].note and said["closure", "stored-closure-strong-self"].line in (3, 6)
    assert catalog(spark).count() == len(RULES) + 1 == 14
    assert check_types(rows(spark).limit(0)).count() == 0
