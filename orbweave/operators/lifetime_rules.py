"""The lifetime rules over nested facts: one scan of types for all rules, findings exploded once.

types: one row a type, with path, name, is_reference (three-valued), member_names, inherited, attributes, and
arrays of structs dead_weak (line, col), stored_properties (name, strength, refs, published, transient, pos),
stored_closures (pos, member, capture, is_method), api_calls, task_spawns and release_sites (kind, in_deinit). A capture or consumption is
a struct (tag, name, flag); a null capture means that there is no closure, which differs from tag none.

Defined results: a null array counts as empty, a null flag as false, but for `repeats` of a timer with a
target, where null counts as repeating; types of unknown kind (is_reference null) pass no gated rule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "struct<tag:string,name:string,flag:boolean>"
POS = "struct<line:int,col:int>"
CALL = (f"struct<kind:{TAG},pos:{POS},repeats:boolean,target_is_self:boolean,receiver_is_self_member:boolean,"
        f"upstream:string,capture:{TAG},via_nested_list_only:boolean,consumption:{TAG}>")
TYPE = (f"path string, name string, is_reference boolean, member_names array<string>, inherited array<string>, attributes array<string>, dead_weak array<{POS}>, "
        f"stored_properties array<struct<name:string,strength:string,refs:array<string>,published:boolean,transient:boolean,pos:{POS}>>, "
        f"stored_closures array<struct<pos:{POS},member:string,capture:{TAG},is_method:boolean>>, api_calls array<{CALL}>, "
        f"task_spawns array<struct<pos:{POS},capture:{TAG},endless:boolean,consumption:{TAG}>>, release_sites array<struct<kind:string,in_deinit:boolean>>")
FINDING = "struct<rule:string,severity:string,line:int,col:int,message:string,note:string>"

# --- fixed values: names that facts and configurations use ---------------------------------------
TOKEN_KINDS = ("sink", "assign_on", "block_observer", "key_path_observer", "periodic_observer", "user_token", "user_sink")
SINK_KINDS = ("sink", "user_sink")
ANCHORED_KINDS = ("timer_block", "block_observer", "periodic_observer", "dispatch_handler")
TEST_CASE = "XCTestCase"
LASTING_OWNERS = ("UIApplicationDelegate", "NSApplicationDelegate")
LASTING_MEMBER = "shared"
DELEGATE_SUFFIXES = ("delegate", "datasource")
# -------------------------------------------------------------------------------------------------


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def reachable_release(sites: Column, kind: str) -> Column:
    """Some release site of the kind lies outside a deinitializer."""
    return _true(F.exists(sites, lambda s: (s["kind"] == kind) & ~_true(s["in_deinit"])))


def deinit_only_release(sites: Column, kind: str) -> Column:
    """There are release sites of the kind, and all lie in deinitializers."""
    own = F.filter(sites, lambda s: s["kind"] == kind)
    return _true((F.size(own) > 0) & F.forall(own, lambda s: _true(s["in_deinit"])))


def produces_token(call: Column) -> Column:
    """The call returns a token that somebody must own."""
    return _true(call["kind"]["tag"].isin(*TOKEN_KINDS))


def feeds_sink(call: Column) -> Column:
    """The closure of the call is held by a subscription."""
    return _true(call["kind"]["tag"].isin(*SINK_KINDS))


def stores_into_self(consumption: Column) -> Column:
    """The result ends up in a member of self."""
    return _true((consumption["tag"] == "self_member") | ((consumption["tag"] == "store_in") & _true(consumption["flag"])))


def is_strong(capture: Column) -> Column:
    return _true(capture["tag"] == "strong")


def lives_as_long_as_process(inherited: Column, members: Column) -> Column:
    """The type is an application delegate, or has a shared instance."""
    return _true(F.arrays_overlap(inherited, F.array(*map(F.lit, LASTING_OWNERS)))) | _true(F.array_contains(members, LASTING_MEMBER))


def looks_like_delegate(prop: Column) -> Column:
    """The name of a property, or of a type that it refers to, ends like a delegate's."""
    ends = lambda text: _any([F.endswith(F.lower(text), F.lit(s)) for s in DELEGATE_SUFFIXES])
    return _true(ends(prop["name"])) | _true(F.exists(prop["refs"], ends))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


@dataclass(frozen=True)
class Rule:
    """A rule: what it looks at, when an item of that counts, and what is said about it."""

    id: str
    severity: str
    summary: str
    items: str
    when: Callable[[Column], Column]
    message: Callable[[Column], Column]
    note: Callable[[Column], Column]
    pos: Callable[[Column], Column] = field(default=lambda x: x["pos"])
    #: the severity of an item, from the configured one
    raised: Callable[[Column, Column], Column] = field(default=lambda x, configured: configured)
    #: what the type must fulfil, beside being a reference type if gated
    of_type: Callable[[], Column] = field(default=lambda: F.lit(True))
    gated: bool = True
    enabled: bool = True


def _said(text: str) -> Callable[[Column], Column]:
    return lambda x: F.lit(text)


def _by_deinit(kind: str, definite: str, open_end: str) -> Callable[[Column], Column]:
    return lambda x: F.when(deinit_only_release(F.col("release_sites"), kind), definite).otherwise(open_end)


def _error_if_deinit_only(kind: str):
    return lambda x, configured: F.when(deinit_only_release(F.col("release_sites"), kind), "error").otherwise(configured)


def _unreleased(kind: str):
    return lambda: ~reachable_release(F.col("release_sites"), kind)


def _is(call: Column, kind: str) -> Column:
    return _true(call["kind"]["tag"] == kind)


def _not_finite(call: Column) -> Column:
    return ~_true(call["upstream"] == "finite")


def _configured_if_endless(call: Column, configured: Column) -> Column:
    return F.when(call["upstream"] == "infinite", configured).otherwise("warning")


def _test_note(note: Column) -> Column:
    return F.when(_true(F.array_contains("inherited", TEST_CASE)), F.concat(note, F.lit("; a test instance is never freed during its run"))).otherwise(note)


def _timer(call: Column) -> Column:
    target = _is(call, "timer_target") & _true(call["target_is_self"]) & F.coalesce(call["repeats"], F.lit(True))
    block = _is(call, "timer_block") & _true(call["repeats"]) & is_strong(call["capture"])
    return target | block | (_is(call, "display_link") & _true(call["target_is_self"]))


def _token_lost(call: Column) -> Column:
    """A call whose token counts for the rules about lost tokens."""
    observer = _is(call, "block_observer")
    forever = is_strong(call["capture"]) | lives_as_long_as_process(F.col("inherited"), F.col("member_names"))
    return produces_token(call) & ~(observer & forever)


def _no_test() -> Column:
    return ~_true(F.array_contains("inherited", TEST_CASE))


def _in_local(consumption: Column) -> Column:
    tag = consumption["tag"]
    return _true(tag.isin("local_only", "store_in_captured_local") | ((tag == "store_in") & ~_true(consumption["flag"])))


def _local_message(call: Column) -> Column:
    used = call["consumption"]
    return (F.when(used["tag"] == "local_only", F.concat(F.lit("the token is held by local "), used["name"], F.lit(" only")))
            .when(used["tag"] == "store_in", "the token is held by a local collection only")
            .otherwise(F.concat(F.lit("the token is held by captured local "), used["name"])))


RULES: tuple[Rule, ...] = (
    Rule("stored-closure-strong-self", "error", "A closure in a member holds the owner.", "stored_closures",
         lambda x: is_strong(x["capture"]),
         lambda x: F.concat(F.when(_true(x["is_method"]), "a method of self held by ").otherwise("a closure held by "), x["member"], F.lit(" keeps self")),
         lambda x: F.when(_true(x["is_method"]), "wrap the method in a closure with a weak self").otherwise("capture self weakly")),
    Rule("timer-retains-self", "warning", "A repeating timer holds its target.", "api_calls", _timer,
         lambda x: F.concat(F.lit("a repeating timer keeps self: "), x["kind"]["tag"]),
         _by_deinit("invalidate", "it is only stopped in deinit, which can't run", "it is never stopped"),
         raised=_error_if_deinit_only("invalidate"), of_type=_unreleased("invalidate")),
    Rule("notification-observer-leak", "warning", "An observer's block holds self until it is removed.", "api_calls",
         lambda x: _is(x, "block_observer") & is_strong(x["capture"]), _said("an observer's block keeps self"),
         _by_deinit("removeObserver", "it is only removed in deinit, which can't run", "it is never removed"),
         raised=_error_if_deinit_only("removeObserver"), of_type=_unreleased("removeObserver")),
    Rule("combine-sink-self-cycle", "error", "A subscription in a member holds its owner through a closure.", "api_calls",
         lambda x: feeds_sink(x) & is_strong(x["capture"]) & stores_into_self(x["consumption"]) & _not_finite(x),
         lambda x: F.when(_true(x["via_nested_list_only"]), "a nested weak capture makes the subscription's closure keep self").otherwise("the closure of a subscription in a member keeps self"),
         lambda x: _test_note(F.when(x["upstream"] == "infinite", "its publisher never completes").otherwise("whether its publisher completes is unknown")),
         raised=_configured_if_endless),
    Rule("combine-assign-self-cycle", "error", "An assignment to self is held by self.", "api_calls",
         lambda x: _is(x, "assign_on") & _true(x["target_is_self"]) & stores_into_self(x["consumption"]) & _not_finite(x),
         _said("an assignment to self in a member keeps self"), lambda x: _test_note(F.lit("assign to a published projection instead")),
         raised=_configured_if_endless),
    Rule("task-nonterminating-self", "warning", "An endless task holds self.", "task_spawns",
         lambda x: is_strong(x["capture"]) & _true(x["endless"]),
         lambda x: F.concat(F.lit("an endless task keeps self"), F.when(_true(x["capture"]["flag"]), " without naming it").otherwise("")),
         lambda x: F.when(stores_into_self(x["consumption"]), "self holds the task, too").otherwise("nothing cancels it"),
         raised=lambda x, configured: F.when(stores_into_self(x["consumption"]), "error").otherwise(configured), of_type=_unreleased("cancel")),
    Rule("unstored-lifetime-token", "warning", "A token that must be owned is dropped.", "api_calls",
         lambda x: _token_lost(x) & _true(x["consumption"]["tag"] == "discarded"),
         lambda x: F.concat(F.lit("a token is dropped: "), F.coalesce(x["kind"]["name"], x["kind"]["tag"])), _said("keep it in a member"), of_type=_no_test, gated=False),
    Rule("token-stored-in-local", "warning", "A token that must be owned dies with a local.", "api_calls",
         lambda x: _token_lost(x) & _in_local(x["consumption"]), _local_message, _said("keep it in a member"), of_type=_no_test, gated=False),
    Rule("urlsession-delegate-leak", "warning", "A session holds its delegate until it is invalidated.", "api_calls",
         lambda x: _is(x, "session_delegate") & _true(x["target_is_self"]), _said("a session keeps self as its delegate"),
         _by_deinit("sessionInvalidate", "it is only invalidated in deinit, which can't run", "it is never invalidated"),
         raised=_error_if_deinit_only("sessionInvalidate"), of_type=_unreleased("sessionInvalidate")),
    Rule("dispatch-source-cycle", "error", "A dispatch source in a member holds its owner through a handler.", "api_calls",
         lambda x: _is(x, "dispatch_handler") & _true(x["receiver_is_self_member"]) & is_strong(x["capture"]), _said("the handler of a source in a member keeps self"),
         _by_deinit("cancel", "it is only cancelled in deinit, which can't run", "it is never cancelled"), of_type=_unreleased("cancel")),
    Rule("unowned-outlives-owner", "warning", "A closure that outlives its owner captures it unowned.", "api_calls",
         lambda x: _true(x["kind"]["tag"].isin(*ANCHORED_KINDS)) & _true(x["capture"]["tag"] == "unowned"),
         _said("an unowned self may be freed before its closure"), _said("capture self weakly")),
    Rule("dead-weak-capture", "warning", "A weak capture that nothing uses.", "dead_weak", lambda x: F.lit(True),
         _said("a weak self is never used"), _said("drop it"), pos=lambda x: x, gated=False, enabled=False),
    Rule("delegate-strong-property", "warning", "A delegate is held strongly.", "stored_properties",
         lambda x: _true(x["strength"] == "strong") & looks_like_delegate(x),
         lambda x: F.concat(F.lit("a delegate is held strongly: "), x["name"]), _said("declare it weak"), enabled=False),
)
#: Found over the whole graph and not in a type; see graph.component_cycles.
GRAPH_RULE = ("mutual-strong-properties", "warning", "Types hold each other through members.")


def catalog(spark: SparkSession) -> DataFrame:
    """(rule, severity, enabled, summary) of every rule."""
    rows = [(r.id, r.severity, r.enabled, r.summary) for r in RULES] + [(GRAPH_RULE[0], GRAPH_RULE[1], True, GRAPH_RULE[2])]
    return spark.createDataFrame(rows, "rule string, severity string, enabled boolean, summary string")


def _findings(rule: Rule, configured: Column) -> Column:
    """The findings of one rule in a type, an array."""
    def finding(x: Column) -> Column:
        pos = rule.pos(x)
        return F.struct(F.lit(rule.id).alias("rule"), rule.raised(x, configured).alias("severity"), pos["line"].alias("line"), pos["col"].alias("col"),
                        rule.message(x).alias("message"), rule.note(x).alias("note"))

    gate = rule.of_type() & (_true(F.col("is_reference")) if rule.gated else F.lit(True))
    items = F.when(gate, F.filter(F.col(rule.items), rule.when))
    return F.coalesce(F.transform(items, finding).cast(f"array<{FINDING}>"), F.array().cast(f"array<{FINDING}>"))


def check_types(types: DataFrame, overrides: Mapping[str, Mapping] | None = None, only: Collection[str] | None = None) -> DataFrame:
    """(path, type, rule, severity, line, col, message, note): every finding of every rule that is on.

    overrides: {rule: {"enabled": bool, "severity": str}}; only: rules to look for, of those that are on. An
    unknown rule is an error. Facts that no rule looked for reads aren't gathered.
    """
    overrides = overrides or {}
    if unknown := {*overrides, *(only or ())} - {r.id for r in RULES} - {GRAPH_RULE[0]}:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    active = [(r, overrides.get(r.id, {})) for r in RULES if overrides.get(r.id, {}).get("enabled", r.enabled) and (only is None or r.id in only)]
    findings = F.concat(F.array().cast(f"array<{FINDING}>"), *[_findings(r, F.lit(own.get("severity", r.severity))) for r, own in active])
    return types.select("path", F.col("name").alias("type"), F.explode(findings).alias("f")).select("path", "type", "f.*")
