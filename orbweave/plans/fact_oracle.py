"""SQL for DuckDB that gives the rows of plans.fact_queries: flat joins of line items with their orders."""

from orbweave.plans.fact_queries import CAPTURES, KINDS, NAMES, RELEASES, USES
from orbweave.plans.oracle import fnv_hex


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


BASE = f"""
l AS (SELECT *, (l_linenumber + l_suppkey) % 7 AS role, CASE WHEN l_quantity <= 45 THEN ({_list(CAPTURES)})[l_suppkey % 5 + 1] END AS cap,
  l_suppkey % 5 = 2 AS implicit, ({_list(USES)})[(l_partkey // 12) % 9 + 1] AS used, (l_partkey // 12) % 9 AS u, ({_list(KINDS)})[l_partkey % 12 + 1] AS kind,
  CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END AS repeats, CASE l_returnflag WHEN 'R' THEN 'infinite' WHEN 'A' THEN 'finite' ELSE 'unknown' END AS upstream FROM lineitem),
r AS (SELECT l_orderkey AS k, {", ".join(f"coalesce(bool_or(l_partkey % 4 = {i} AND l_linestatus <> 'F'), false) AS reach_{n}, coalesce(bool_or(l_partkey % 4 = {i}), false) AS any_{n}" for i, n in enumerate(RELEASES))}
  FROM l WHERE role = 2 GROUP BY l_orderkey),
o AS (SELECT o_orderkey, 'customer ' || o_custkey AS path, CAST(o_orderkey AS VARCHAR) AS type, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority < '4' END AS ref,
  o_custkey % 5 = 0 AS test, o_custkey % 5 = 1 OR o_custkey % 7 = 0 AS lasting, o_orderstatus = 'P' AS model,
  {", ".join(f"coalesce(reach_{n}, false) AS reach_{n}, coalesce(any_{n}, false) AS any_{n}" for n in RELEASES)} FROM orders LEFT JOIN r ON k = o_orderkey),
i AS (SELECT o.*, l.*, CAST(l_linenumber AS INTEGER) AS line, CAST(l_suppkey AS INTEGER) AS col, coalesce(cap = 'strong', false) AS strong, used = 'self_member' OR u = 4 AS into_self, role >= 4 AS call FROM l JOIN o ON l_orderkey = o_orderkey),
"""


def _rule(rule, where, severity, message, note):
    return f"SELECT path, type, '{rule}' AS rule, {severity} AS severity, line, col, {message} AS message, {note} AS note FROM i WHERE {where}"


def _deinit(kind, definite, open_end):
    return f"CASE WHEN any_{kind} THEN '{definite}' ELSE '{open_end}' END"


def _test(note):
    return f"({note}) || CASE WHEN test THEN '; a test instance is never freed during its run' ELSE '' END"


ENDLESS = "CASE WHEN upstream = 'infinite' THEN 'error' ELSE 'warning' END"
LOST = "call AND kind IN ('sink', 'assign_on', 'block_observer', 'key_path_observer', 'periodic_observer', 'user_token', 'user_sink') AND NOT (kind = 'block_observer' AND (strong OR lasting)) AND NOT test"
FOUND = {
    "stored-closure-strong-self": _rule("stored-closure-strong-self", "role = 1 AND ref AND strong", "'error'",
                                        "CASE WHEN l_discount > 0.07 THEN 'a method of self held by m' ELSE 'a closure held by m' END || l_partkey || ' keeps self'",
                                        "CASE WHEN l_discount > 0.07 THEN 'wrap the method in a closure with a weak self' ELSE 'capture self weakly' END"),
    "timer-retains-self": _rule("timer-retains-self", "call AND ref AND NOT reach_invalidate AND (kind = 'timer_target' AND l_tax > 0.03 AND coalesce(repeats, true) OR kind = 'timer_block' AND coalesce(repeats, false) AND strong OR kind = 'display_link' AND l_tax > 0.03)",
                                "CASE WHEN any_invalidate THEN 'error' ELSE 'warning' END", "'a repeating timer keeps self: ' || kind", _deinit("invalidate", "it is only stopped in deinit, which can''t run", "it is never stopped")),
    "notification-observer-leak": _rule("notification-observer-leak", "call AND ref AND NOT reach_removeObserver AND kind = 'block_observer' AND strong", "CASE WHEN any_removeObserver THEN 'error' ELSE 'warning' END",
                                        "'an observer''s block keeps self'", _deinit("removeObserver", "it is only removed in deinit, which can''t run", "it is never removed")),
    "combine-sink-self-cycle": _rule("combine-sink-self-cycle", "call AND ref AND kind IN ('sink', 'user_sink') AND strong AND into_self AND upstream <> 'finite'", ENDLESS,
                                     "CASE WHEN l_quantity < 5 THEN 'a nested weak capture makes the subscription''s closure keep self' ELSE 'the closure of a subscription in a member keeps self' END",
                                     _test("CASE WHEN upstream = 'infinite' THEN 'its publisher never completes' ELSE 'whether its publisher completes is unknown' END")),
    "combine-assign-self-cycle": _rule("combine-assign-self-cycle", "call AND ref AND kind = 'assign_on' AND l_tax > 0.03 AND into_self AND upstream <> 'finite'", ENDLESS,
                                       "'an assignment to self in a member keeps self'", _test("'assign to a published projection instead'")),
    "task-nonterminating-self": _rule("task-nonterminating-self", "role = 0 AND ref AND NOT reach_cancel AND strong AND l_tax > 0.02", "CASE WHEN into_self THEN 'error' ELSE 'warning' END",
                                      "'an endless task keeps self' || CASE WHEN implicit THEN ' without naming it' ELSE '' END", "CASE WHEN into_self THEN 'self holds the task, too' ELSE 'nothing cancels it' END"),
    "unstored-lifetime-token": _rule("unstored-lifetime-token", f"{LOST} AND used = 'discarded'", "'warning'", "'a token is dropped: ' || CASE WHEN kind = 'user_token' THEN 'Token' ELSE kind END", "'keep it in a member'"),
    "token-stored-in-local": _rule("token-stored-in-local", f"{LOST} AND (used IN ('local_only', 'store_in_captured_local') OR u = 8)", "'warning'",
                                   "CASE used WHEN 'local_only' THEN 'the token is held by local x' || l_suppkey || ' only' WHEN 'store_in' THEN 'the token is held by a local collection only' ELSE 'the token is held by captured local x' || l_suppkey END", "'keep it in a member'"),
    "urlsession-delegate-leak": _rule("urlsession-delegate-leak", "call AND ref AND NOT reach_sessionInvalidate AND kind = 'session_delegate' AND l_tax > 0.03", "CASE WHEN any_sessionInvalidate THEN 'error' ELSE 'warning' END",
                                      "'a session keeps self as its delegate'", _deinit("sessionInvalidate", "it is only invalidated in deinit, which can''t run", "it is never invalidated")),
    "dispatch-source-cycle": _rule("dispatch-source-cycle", "call AND ref AND NOT reach_cancel AND kind = 'dispatch_handler' AND l_discount > 0.05 AND strong", "'error'",
                                   "'the handler of a source in a member keeps self'", _deinit("cancel", "it is only cancelled in deinit, which can''t run", "it is never cancelled")),
    "unowned-outlives-owner": _rule("unowned-outlives-owner", "call AND ref AND kind IN ('timer_block', 'block_observer', 'periodic_observer', 'dispatch_handler') AND cap = 'unowned'", "'warning'",
                                    "'an unowned self may be freed before its closure'", "'capture self weakly'"),
}
EXTRA = {
    "dead-weak-capture": _rule("dead-weak-capture", "role = 1 AND l_suppkey % 5 = 3 AND l_quantity < 25", "'warning'", "'a weak self is never used'", "'drop it'"),
    "delegate-strong-property": _rule("delegate-strong-property", "role = 3 AND ref AND l_returnflag <> 'R' AND l_suppkey % 4 IN (0, 2)", "'error'", f"'a delegate is held strongly: ' || ({_list(NAMES)})[l_suppkey % 4 + 1]", "'declare it weak'"),
}


def _union(*names) -> str:
    return " UNION ALL ".join(FOUND[n] for n in names)


EVERY = f"WITH {BASE} f AS ({_union(*FOUND)})"
FILES = "n AS (SELECT 'customer ' || c_custkey AS path, CASE WHEN c_acctbal < -900 THEN 'not valid UTF-8' END AS detail, c_custkey FROM customer)"
CYCLES = ("combine-sink-self-cycle", "combine-assign-self-cycle", "dispatch-source-cycle", "task-nonterminating-self")
ANCHORS = ("timer-retains-self", "notification-observer-leak", "urlsession-delegate-leak", "unowned-outlives-owner")
CONFIGURED = [s.replace("combine-sink-self-cycle' AS rule, " + ENDLESS, "combine-sink-self-cycle' AS rule, 'warning'") for n, s in (FOUND | EXTRA).items() if n != "timer-retains-self"]

ORACLE = {
    "rules_cycles": f"WITH {BASE} f AS ({_union(*CYCLES)}) SELECT * FROM f",
    "rules_anchors": f"WITH {BASE} f AS ({_union(*ANCHORS)}) SELECT * FROM f",
    "rules_tokens": f"WITH {BASE} f AS ({_union('unstored-lifetime-token', 'token-stored-in-local')}) SELECT * FROM f",
    "rules_closures": f"WITH {BASE} f AS ({_union('stored-closure-strong-self')}) SELECT * FROM f",
    "rules_configured": f"WITH {BASE} f AS ({' UNION ALL '.join(CONFIGURED)}) SELECT path, type, rule, severity, line, col FROM f",
    "baseline_round_trip": f"""WITH {BASE} f AS ({_union(*CYCLES)}), p AS (SELECT *, {fnv_hex("concat_ws('|', rule, path, line, col, message)")} AS fingerprint FROM f)
SELECT path, type, rule, line, col FROM p WHERE fingerprint NOT IN (SELECT fingerprint FROM p WHERE CAST(type AS BIGINT) % 2 = 0)""",
    "report_summary": f"""{EVERY}, {FILES} SELECT count_if(severity = 'error' AND line <> 2) AS errors, count_if(severity = 'warning' AND line <> 2) AS warnings, count_if(line = 2) AS suppressed,
  (SELECT count(*) FROM n) AS files, (SELECT count(detail) FROM n) AS degraded, count_if(line = 3) AS baselined,
  (SELECT count_if(detail IS NULL AND c_custkey % 10 = 7) FROM n) AS cache_hits, (SELECT count_if(detail IS NOT NULL OR c_custkey % 10 <> 7) FROM n) AS cache_misses FROM f""",
    "report_lines": f"""WITH {BASE} f AS ({_union(*ANCHORS)}), {FILES} SELECT path || ':' || line || ':' || col || ': ' || severity || ': [' || rule || '] ' || message || ' - ' || note AS value FROM f
UNION ALL SELECT path || ':1:1: warning: file skipped: ' || detail FROM n WHERE detail IS NOT NULL""",
    "report_sarif": f"""WITH {BASE} f AS ({_union(*CYCLES)}), p AS (SELECT *, {fnv_hex("concat_ws('|', rule, path, line, col, message)")} AS fingerprint FROM f)
SELECT path, '2.1.0' AS version, CAST(14 AS BIGINT) AS n_rules, count(*) AS n_results, string_agg(rule || ' ' || severity || ' ' || fingerprint, ',' ORDER BY line, col, rule, message, severity) AS results FROM p GROUP BY path""",
    "doc_state_log": """
SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'close' ELSE 'change' END AS kind, CASE WHEN event_type <> 'signup' THEN value END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'click', 'purchase')) WHERE n = 1""",
    "findings_by_path": f"{EVERY} SELECT path, count(*) AS n, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM f GROUP BY path",
    "fact_graph_edges": f"""WITH {BASE} p AS (SELECT type AS src, CAST(unnest([l_partkey, l_orderkey]) AS VARCHAR) AS dst, ({_list(NAMES)})[l_suppkey % 4 + 1] AS property, line, col
  FROM i WHERE role = 3 AND ref AND l_returnflag <> 'R' AND (l_tax > 0.05 OR NOT model))
SELECT p.* FROM p WHERE src <> dst AND dst IN (SELECT type FROM o WHERE ref)""",
    "external_upgrade": """SELECT CAST(o_orderkey AS VARCHAR) AS type, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority < '4' ELSE c_mktsegment = 'BUILDING' END AS is_reference,
  array_to_string(list_sort(list_distinct([CASE o_custkey % 5 WHEN 0 THEN 'XCTestCase' WHEN 1 THEN 'UIApplicationDelegate' ELSE 'NSObject' END] || CASE WHEN o_orderpriority = '5-LOW' AND c_custkey IS NOT NULL THEN [c_mktsegment, 'NSObject'] ELSE [] END)), ',') AS inherited
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "external_confirmed": f"""WITH {BASE} p AS (SELECT DISTINCT unnest([l_partkey, l_orderkey]) AS name FROM i WHERE role = 3 AND ref AND l_returnflag <> 'R')
SELECT CAST(name AS VARCHAR) AS name FROM p WHERE CAST(name AS VARCHAR) NOT IN (SELECT type FROM o WHERE ref) AND name IN (SELECT p_partkey FROM part WHERE p_size > 10)""",
    "member_difference": """WITH d AS (SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'R') AS back FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, coalesce(string_agg(l_partkey, ',' ORDER BY l_partkey) FILTER (NOT back), '') AS rest FROM d GROUP BY l_orderkey""",
    "newest_time": "SELECT c_custkey, coalesce(max(ts), TIMESTAMP '1970-01-01') AS newest FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey",
    "cache_salted": """SELECT doc_id, md5((SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) || ';' || (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation) || ';' || coalesce(text, '')) AS key FROM documents""",
    "merged_types": """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderpriority AS path, CASE WHEN o_orderpriority = '1-URGENT' THEN true WHEN o_orderpriority <> '5-LOW' THEN false END AS ref, o_orderstatus, l_linenumber, l_returnflag
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT name, bool_or(ref) AS is_reference, count(DISTINCT path) AS files, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS members,
  string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS inherited, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS attributes FROM (SELECT name, path, ref, o_orderstatus, l_linenumber, l_returnflag FROM t) GROUP BY name""",
    "index_gate": """WITH u AS (SELECT l_orderkey, max(l_shipdate) AS seen FROM lineitem GROUP BY l_orderkey),
s AS (SELECT count(*) AS stale FROM orders LEFT JOIN u ON l_orderkey = o_orderkey WHERE NOT coalesce(o_orderdate <= seen, false))
SELECT stale, CASE WHEN stale = 0 THEN (SELECT count(*) FROM supplier) ELSE 0 END AS usable FROM s""",
}
