"""Directives in the comments of pages, and what they suppress; each with its SQL.

A page's lines are its tags. Lines that open no link, item or paragraph carry a comment, whose shape depends on
the page and the line: directives of all kinds, and comments that are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import suppression
from orbweave.plans.queries import table
from orbweave.sources.directives import directives_of

RULES = ("link", "item", "para")
#: {0} is the line's number. The last six are no directives, or say nothing.
SHAPES = (
    "// @ow:accept -- reason {0}", "// @ow:accept:this link, para -- why -- and why", "/* @orbweave:accept:next link,unknown\tpara*/", "// @ow:disable all", "// @orbweave:enable",
    "/*@ow:disable para*/", "//   @ow:enable para,item  ", "// @ow:accept item --", "// @ow:accept:this not-a-rule", "// ow:accept", "// #ow:expect link", "nothing {0}", "  // @ow:accept", "// @ow:allow link",
)


def page_lines(spark, sf_dir) -> DataFrame:
    """(path, line, rule, comment): rule of lines with a finding, comment of the others."""
    lines = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.posexplode(F.split("html", "<")).alias("line", "tag"))
    rule = F.when(F.startswith("tag", F.lit("a ")), "link").when(F.startswith("tag", F.lit("li>")), "item").when(F.startswith("tag", F.lit("p>")), "para")
    shape = F.get(F.array(*map(F.lit, SHAPES)), F.pmod(F.col("path") * 3 + F.col("line") * 5, F.lit(len(SHAPES))).cast("int"))
    return lines.select("path", "line", rule.alias("rule"), F.when(rule.isNull(), F.replace(shape, F.lit("{0}"), F.col("line").cast("string"))).alias("comment"))


def _directives(spark, sf_dir) -> DataFrame:
    comments = page_lines(spark, sf_dir).filter("comment is not null").select("path", F.col("line").alias("ord"), "line", "comment")
    return directives_of(comments, "comment", RULES)


def page_directives(spark, sf_dir):
    return _directives(spark, sf_dir).select("path", "line", "kind", F.array_join("rules", ",").alias("rules"), "reason")


def page_suppression(spark, sf_dir):
    """What becomes of each finding under the page's directives."""
    found = page_lines(spark, sf_dir).filter("rule is not null").select("path", "line", "rule")
    return suppression.suppress(found, _directives(spark, sf_dir).drop("comment"), list(RULES)).select("path", "line", "rule", "status", "accept_reason")


QUERIES = {f.__name__: f for f in (page_directives, page_suppression)}

_SHAPES = "[" + ", ".join("'" + s.replace("\t", "' || chr(9) || '") + "'" for s in SHAPES) + "]"
_BASE = rf"""WITH t AS (SELECT page_id AS path, unnest(string_split(html, '<')) AS tag, generate_subscripts(string_split(html, '<'), 1) - 1 AS line FROM pages),
l AS (SELECT path, line, CASE WHEN starts_with(tag, 'a ') THEN 'link' WHEN starts_with(tag, 'li>') THEN 'item' WHEN starts_with(tag, 'p>') THEN 'para' END AS rule FROM t),
c AS (SELECT path, line, replace(({_SHAPES})[CAST((path * 3 + line * 5) % {len(SHAPES)} AS INTEGER) + 1], '{{0}}', CAST(line AS VARCHAR)) AS comment FROM l WHERE rule IS NULL),
s AS (SELECT path, line, trim(regexp_replace(regexp_replace(comment, '^(//|/\*)', ''), '\*/$', ''), ' ' || chr(9)) AS body FROM c),
p AS (SELECT path, line, regexp_extract(body, '^@(ow|orbweave):([^ \t-]*)((?:[^-]|-[^-])*?)[ \t]*(--(.*))?$', ['space', 'kind', 'names', 'mark', 'reason']) AS m FROM s WHERE regexp_matches(body, '^@(ow|orbweave):')),
n AS (SELECT path, line, m.kind AS kind, list_filter(regexp_split_to_array(m.names, '[ \t,]+'), lambda x: x <> '') AS names, CASE WHEN m.mark <> '' THEN trim(m.reason) END AS reason
  FROM p WHERE m.kind IN ('accept', 'accept:this', 'accept:next', 'disable', 'enable')),
d AS (SELECT path, line, kind, reason, CASE WHEN len(names) = 0 OR list_contains(names, 'all') THEN [] ELSE list_sort(list_distinct(list_filter(names, lambda x: x IN ('link', 'item', 'para')))) END AS rules, names FROM n),
e AS (SELECT * FROM d WHERE len(rules) > 0 OR len(names) = 0 OR list_contains(names, 'all'))"""
ORACLE = {
    "page_directives": f"{_BASE} SELECT path, CAST(line AS INTEGER) AS line, kind, array_to_string(rules, ',') AS rules, reason FROM e",
    "page_suppression": f"""{_BASE}, f AS (SELECT path, line, rule FROM l WHERE rule IS NOT NULL),
a AS (SELECT f.path, f.line, f.rule, arg_min(struct_pack(reason := reason), e.line) AS first FROM f JOIN e ON e.path = f.path AND (len(e.rules) = 0 OR list_contains(e.rules, f.rule))
  AND (e.kind IN ('accept', 'accept:this') AND e.line = f.line OR e.kind IN ('accept', 'accept:next') AND e.line + 1 = f.line) GROUP BY ALL),
r AS (SELECT f.path, f.line, f.rule, arg_max(e.kind, e.line) AS region FROM f JOIN e ON e.path = f.path AND e.line <= f.line AND e.kind IN ('disable', 'enable') AND (len(e.rules) = 0 OR list_contains(e.rules, f.rule)) GROUP BY ALL)
SELECT f.path, CAST(f.line AS INTEGER) AS line, f.rule, CASE WHEN a.path IS NOT NULL THEN 'accepted' WHEN region = 'disable' THEN 'region' ELSE 'kept' END AS status, a.first.reason AS accept_reason
FROM f LEFT JOIN a ON a.path = f.path AND a.line = f.line LEFT JOIN r ON r.path = f.path AND r.line = f.line""",
}
