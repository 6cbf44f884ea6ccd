"""Receiver chains, locals that escape, and findings in the order of the whole report; each with its SQL.

An order is a method, or the chain of a call in it; its line items are the links, the stored results or the
references to locals. A customer's type has the suppliers of the customer's nation as members.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import chains, lifetime_rules, report
from orbweave.operators.rank import numbered
from orbweave.plans.fact_oracle import EVERY
from orbweave.plans.fact_queries import facts
from orbweave.plans.oracle import fnv_hex
from orbweave.plans.queries import table

MARKERS = (*chains.FINITE, *chains.INFINITE, *chains.SUBJECTS, *chains.CENTER)
#: Of 80 kinds of links the first are markers, the last four projected values, and the others suppliers by name.
KINDS = 80


def chain_links(spark, sf_dir):
    """(o_orderkey, l_linenumber, l_partkey, l_suppkey, name, is_member)."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    kind = F.pmod("l_partkey", F.lit(KINDS))
    own = F.concat(F.when(kind >= KINDS - 4, "$m").otherwise("m"), F.col("l_suppkey").cast("string"))
    name = F.when(kind < len(MARKERS), F.get(F.array(*map(F.lit, MARKERS)), kind.cast("int"))).otherwise(own)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", name.alias("name"), (kind >= len(MARKERS)).alias("_own"))
    joined = lines.join(orders, "o_orderkey").join(suppliers, "l_suppkey", "left")
    return joined.withColumn("is_member", F.col("_own") & (F.col("c_nationkey") == F.col("s_nationkey"))).drop("_own")


def receiver_chains(spark, sf_dir):
    """What each order's chain receives, and the member that it starts from."""
    return chains.classify(chain_links(spark, sf_dir), ["o_orderkey"], F.struct("l_linenumber", "l_partkey", "l_suppkey"))


def receiver_chains_resolved(spark, sf_dir):
    """The chains, infinite as well where they start from a member that a supplier in the red holds."""
    keyed = receiver_chains(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    running = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"), F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("root"))
    return chains.resolve_roots(keyed.join(customers, "o_custkey"), running, ["nation"]).select("o_orderkey", "upstream", "root")


def local_escapes(spark, sf_dir):
    """Results kept in locals of an order's method, escaping where another line of the order refers to the local."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.pmod(F.col("l_linenumber") + F.col("l_suppkey"), F.lit(3)).alias("role"))
    local = lambda c: F.concat(F.lit("x"), F.pmod(c, F.lit(10)).cast("string")).alias("name")
    consumption = F.when(F.pmod("l_partkey", F.lit(5)) == 0, "returned").otherwise("local_only").alias("consumption")
    stored = lines.filter("role = 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", local("l_suppkey"), consumption)
    return chains.escapes(stored, lines.filter("role <> 0").select("l_orderkey", local("l_partkey")), ["l_orderkey"])


def report_ordered(spark, sf_dir):
    """Every finding with its place in the report: by path, line, column and rule."""
    found = lifetime_rules.check_types(facts(spark, sf_dir)).select("path", "line", "col", "rule", "severity", "message")
    return numbered(found, report.ORDER).select("position", "path", "line", "col", "rule", "severity")


def report_sarif_run(spark, sf_dir):
    """What is read back from the parts of one SARIF run over all findings."""
    rules = [(r.id, r.summary) for r in lifetime_rules.RULES] + [(lifetime_rules.GRAPH_RULE[0], lifetime_rules.GRAPH_RULE[2])]
    parts = report.sarif_run(lifetime_rules.check_types(facts(spark, sf_dir)), rules)
    shape = ("ruleId string, level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, startColumn: int>>>>, "
             "partialFingerprints struct<primary: string>")
    head = F.from_json(F.when(F.col("part") == 0, F.concat("value", F.lit("]}]}"))), "runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>>>")
    read = parts.select("part", F.from_json(F.ltrim("value", F.lit(",")), shape).alias("r"), head["runs"][0]["tool"]["driver"]["rules"].alias("rules"))
    at = F.col("r.locations")[0]["physicalLocation"]
    return read.select("part", F.when(F.col("rules").isNotNull(), F.size("rules").cast("long")).alias("n_rules"), F.col("r.ruleId").alias("rule"), F.col("r.level").alias("severity"), at["artifactLocation"]["uri"].alias("path"),
                       at["region"]["startLine"].alias("line"), at["region"]["startColumn"].alias("col"), F.col("r.partialFingerprints.primary").alias("fingerprint"))


_OWN = f"CASE WHEN l_partkey % {KINDS} >= {KINDS - 4} THEN '$m' ELSE 'm' END || l_suppkey"
_CHAINS = f"""
l AS (SELECT o_orderkey, c_nationkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % {KINDS} < {len(MARKERS)} THEN ({list(MARKERS)})[l_partkey % {KINDS} + 1] ELSE {_OWN} END AS name,
  l_partkey % {KINDS} >= {len(MARKERS)} AND c_nationkey = s_nationkey AS own
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey),
c AS (SELECT o_orderkey, any_value(c_nationkey) AS nation, list(name) AS names, arg_max(name, {{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}}) FILTER (WHERE own) AS root FROM l GROUP BY o_orderkey),
u AS (SELECT o_orderkey, nation, root, CASE WHEN list_has_any(names, {list(chains.FINITE)}) THEN 'finite'
  WHEN list_has_any(names, {list(chains.INFINITE + chains.SUBJECTS)}) OR list_has_all(names, {list(chains.CENTER)}) OR len(list_filter(names, lambda x: x[1] = '$')) > 0 THEN 'infinite' ELSE 'unknown' END AS upstream FROM c)
"""
_PLACED = f"""{EVERY}, p AS (SELECT row_number() OVER (ORDER BY path, line, col, rule, message, severity) AS part, *, {fnv_hex("concat_ws('|', rule, path, line, col, message)")} AS fingerprint FROM f)"""

ORACLE = {
    "receiver_chains": f"WITH {_CHAINS} SELECT o_orderkey, upstream, root FROM u",
    "receiver_chains_resolved": f"""WITH {_CHAINS} SELECT o_orderkey, root,
  CASE WHEN upstream = 'unknown' AND EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND s_nationkey = nation AND 'm' || s_suppkey = root) THEN 'infinite' ELSE upstream END AS upstream FROM u""",
    "local_escapes": """
WITH r AS (SELECT DISTINCT l_orderkey, 'x' || l_partkey % 10 AS name FROM lineitem WHERE (l_linenumber + l_suppkey) % 3 <> 0)
SELECT l.l_orderkey, l_linenumber, l_partkey, l_suppkey, 'x' || l_suppkey % 10 AS name,
  CASE WHEN l_partkey % 5 = 0 THEN 'returned' WHEN r.name IS NULL THEN 'local_only' ELSE 'local_escaping' END AS consumption
FROM lineitem l LEFT JOIN r ON r.l_orderkey = l.l_orderkey AND r.name = 'x' || l_suppkey % 10 WHERE (l_linenumber + l_suppkey) % 3 = 0""",
    "report_ordered": f"{_PLACED} SELECT part AS position, path, line, col, rule, severity FROM p",
    "report_sarif_run": f"""{_PLACED} SELECT part, CAST(NULL AS BIGINT) AS n_rules, rule, severity, path, line, col, fingerprint FROM p
UNION ALL SELECT 0, 14, NULL, NULL, NULL, NULL, NULL, NULL UNION ALL SELECT count(*) + 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p""",
}
QUERIES = {f.__name__: f for f in (receiver_chains, receiver_chains_resolved, local_escapes, report_ordered, report_sarif_run)}
