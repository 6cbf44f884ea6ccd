"""SQL for DuckDB that gives the rows of plans.queries."""

FNV = "list_reduce(list_transform({bytes}, lambda b: b::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"


def fnv_hex(text: str) -> str:
    """FNV-1a 64 of a string, as hex without leading zeros."""
    folded = FNV.format(bytes=f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)")
    return f"format('{{:x}}', ({folded})::UBIGINT)"


LINES = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events)"
SUPPRESSION = f"""
WITH e AS {LINES},
f AS (SELECT user_id AS path, line, event_id, event_type AS rule FROM e WHERE event_type IN ('view', 'error')),
d AS (SELECT user_id AS path, line, event_id AS ord, event_type AS kind, event_id % 3 = 0 AS scoped FROM e WHERE event_type IN ('click', 'signup', 'purchase')),
a AS (SELECT f.event_id, 'reason ' || arg_min(d.ord, d.ord) AS accept_reason FROM f JOIN d ON d.path = f.path AND d.kind = 'click'
  AND f.line - d.line IN (0, 1) AND (NOT d.scoped OR f.rule = 'view') GROUP BY f.event_id),
r AS (SELECT f.event_id, arg_max(CASE d.kind WHEN 'signup' THEN 'disable' ELSE 'enable' END, d.line) AS region FROM f JOIN d ON d.path = f.path AND d.kind <> 'click'
  AND d.line <= f.line AND (NOT d.scoped OR f.rule = 'view') GROUP BY f.event_id)
"""
LINE_RULES = """
SELECT 'deep-discount' AS rule, 'warning' AS severity, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_discount >= 0.08
UNION ALL SELECT 'returned-taxed', 'error', l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.05
UNION ALL SELECT 'bulk', 'warning', l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 45
"""
PRINTED = "SELECT o_orderkey, {} AS fingerprint FROM orders"
ORDER_PRINT = PRINTED.format(fnv_hex("concat_ws('|', o_orderpriority, o_orderstatus, o_custkey, strftime(o_orderdate, '%Y-%m-%d'))"))
REFERENCES = """
r AS (SELECT * FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL),
k AS (SELECT s_suppkey AS name FROM supplier WHERE s_suppkey % 4 <> 1)
"""
EVENT_EDGES = """
e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst)
"""
REACH = f"""
WITH RECURSIVE {EVENT_EDGES.strip()},
p(a, b) AS (SELECT src, dst FROM e UNION SELECT p.a, e.dst FROM p JOIN e ON p.b = e.src),
s AS (SELECT a AS node, min(b) AS component FROM (SELECT x.a, x.b FROM p AS x JOIN p AS y ON x.a = y.b AND x.b = y.a) GROUP BY a)
"""
UPSTREAM = """CASE WHEN list_has_any(w, ['BRUSHED', 'PLATED']) THEN 'finite' WHEN list_has_any(w, ['POLISHED', 'ECONOMY']) THEN 'infinite' ELSE 'unknown' END"""

ORACLE = {
    "rule_severity_upgrade": """
SELECT o_orderkey, CASE WHEN coalesce(any_r, false) THEN 'error' ELSE 'warning' END AS severity FROM orders LEFT JOIN (
  SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_r, bool_or(l_returnflag = 'R' AND l_linestatus <> 'F') AS reach FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
WHERE NOT coalesce(reach, false)""",
    "rule_union": LINE_RULES,
    "rule_config_override": """
SELECT 'deep-discount' AS rule, 'error' AS severity, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_discount >= 0.08
UNION ALL SELECT 'returned-taxed', 'error', l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.05
UNION ALL SELECT 'cheap', 'error', l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_extendedprice < 1500""",
    "reference_gate_null": """
SELECT source, count_if(coalesce(toxic = 1, false)) AS surely, count_if(coalesce(toxic = 1, true)) AS possibly, count_if(toxic IS NULL) AS unknown
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "exclude_filter": "SELECT page_id, url FROM pages WHERE NOT (contains(url, '/fr/') OR contains(url, 'page=2') OR contains(url, 'm.th'))",
    "bounded_scan": "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN n_chars <= 2000 THEN strlen(text) END AS bytes FROM documents",
    "suppression_accept": SUPPRESSION + "SELECT f.event_id, a.event_id IS NOT NULL AS accepted, accept_reason FROM f LEFT JOIN a USING (event_id)",
    "suppression_region": SUPPRESSION + "SELECT f.event_id, region FROM f LEFT JOIN r USING (event_id)",
    "suppression_full": SUPPRESSION + """SELECT f.event_id, path, line, CASE WHEN a.event_id IS NOT NULL THEN 'accepted' WHEN region = 'disable' THEN 'region' ELSE 'kept' END AS status
FROM f LEFT JOIN a USING (event_id) LEFT JOIN r USING (event_id)""",
    "fingerprint_bytes": f"SELECT doc_id, {fnv_hex("text || 'salt'")} || '-' || strlen(text) AS fingerprint FROM documents",
    "fingerprint_finding": ORDER_PRINT,
    "baseline_kept": f"WITH p AS ({ORDER_PRINT}) SELECT * FROM p WHERE fingerprint NOT IN (SELECT fingerprint FROM p WHERE o_orderkey % 2 = 0)",
    "baseline_matched": f"WITH p AS ({ORDER_PRINT}) SELECT * FROM p WHERE fingerprint IN (SELECT fingerprint FROM p WHERE o_orderkey % 2 = 0)",
    "cache_probe": """
WITH d AS (SELECT doc_id AS path, md5(text) AS fingerprint, source FROM documents),
s AS (SELECT path, CASE WHEN path % 10 = 0 THEN md5(fingerprint || 'edited') ELSE fingerprint END AS fingerprint, length(source) AS facts FROM d WHERE path % 7 <> 0)
SELECT source, count(s.path) AS hits, count(*) - count(s.path) AS misses, CAST(sum(facts) AS BIGINT) AS facts
FROM d LEFT JOIN s ON d.path = s.path AND d.fingerprint = s.fingerprint GROUP BY source""",
    "ownership_edges": f"WITH {REFERENCES} SELECT DISTINCT src, dst FROM r WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k) AND src <> dst",
    "unresolved_refs": f"WITH {REFERENCES} SELECT dst, count(*) AS n FROM r WHERE src IN (SELECT name FROM k) AND dst NOT IN (SELECT name FROM k) GROUP BY dst",
    "first_edge_per_pair": """
SELECT l_suppkey AS src, l_partkey AS dst, e.l_shipdate, e.l_orderkey, e.l_linenumber FROM (
  SELECT l_suppkey, l_partkey, min({'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber}) AS e FROM lineitem GROUP BY l_suppkey, l_partkey)""",
    "scc_components": REACH + "SELECT node, component FROM s",
    "shortest_cycle_len": REACH + """,
w(component, node, depth) AS (SELECT component, dst, 1 FROM (SELECT DISTINCT component FROM s) JOIN e ON src = component
  UNION SELECT w.component, e.dst, depth + 1 FROM w JOIN e ON w.node = e.src JOIN s ON s.node = e.dst AND s.component = w.component WHERE w.node <> w.component AND depth < (SELECT count(*) FROM s))
SELECT component, min(depth) AS length FROM w WHERE node = component GROUP BY component""",
    "external_expansion": f"""
WITH RECURSIVE {EVENT_EDGES.strip()},
w(name, depth) AS (SELECT DISTINCT user_id, 0 FROM events WHERE value >= 199.5 UNION SELECT e.dst, depth + 1 FROM w JOIN e ON name = src WHERE depth < (SELECT count(DISTINCT src) FROM e))
SELECT name, min(depth) AS depth FROM w GROUP BY name""",
    "mutual_pairs": """
WITH e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events) WHERE src <> dst)
SELECT x.src, x.dst FROM e AS x JOIN e AS y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst""",
    "strongest_capture": """
SELECT l_orderkey, max(k) AS strongest, bool_and(nested) FILTER (k = 3) AS nested_only FROM (SELECT l_orderkey, l_discount > 0.04 AS nested,
  CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'A' THEN 2 WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS k FROM lineitem) GROUP BY l_orderkey""",
    "upstream_class": f"SELECT p_partkey, {UPSTREAM} AS upstream FROM (SELECT p_partkey, regexp_split_to_array(upper(p_type), '\\s+') AS w FROM part)",
    "upstream_resolve": f"""
SELECT p_partkey, CASE WHEN u = 'unknown' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) THEN 'infinite' ELSE u END AS upstream
FROM (SELECT p_partkey, {UPSTREAM} AS u FROM (SELECT p_partkey, regexp_split_to_array(upper(p_type), '\\s+') AS w FROM part))""",
    "contract_first_match": """
WITH p AS (SELECT p_partkey, p_brand, regexp_split_to_array(upper(p_type), '\\s+') AS w FROM part),
c(ord, callee, base, required, template) AS (VALUES (0, 'SMALL', NULL, ['BRUSHED'], 'tokenProducer'), (1, 'SMALL', 'Brand#1', []::VARCHAR[], 'sinkWrapper'),
  (2, 'STANDARD', NULL, [], 'tokenProducer'), (3, 'SMALL', NULL, [], 'tokenProducer'))
SELECT p_partkey, min(ord) AS ord, arg_min(template, ord) AS template FROM p JOIN c ON w[1] = callee AND (base IS NULL OR base = p_brand) AND list_has_all(w, required) GROUP BY p_partkey""",
    "local_escape": "SELECT l_orderkey, l_suppkey, CASE WHEN count(*) > 1 THEN 'escaping' ELSE 'local-only' END AS consumption FROM lineitem GROUP BY l_orderkey, l_suppkey",
    "innermost_interval": """
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS b FROM orders),
s AS (SELECT o.*, e FROM o JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE e >= b)
SELECT o.o_orderkey, arg_min(s.o_orderkey, {'n': s.e - s.b, 'k': s.o_orderkey}) AS span_key FROM o JOIN s ON o.o_custkey = s.o_custkey AND s.o_orderkey <> o.o_orderkey AND o.b BETWEEN s.b AND s.e GROUP BY o.o_orderkey""",
    "nearest_within": """
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS other FROM orders),
l AS (SELECT DISTINCT l_orderkey, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS day, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, CAST(day AS INTEGER) AS day, arg_min(o_orderkey, {'d': abs(day - other), 'o': other, 'k': o_orderkey}) AS near_key, CAST(arg_min(other, {'d': abs(day - other), 'o': other, 'k': o_orderkey}) AS INTEGER) AS other
FROM l JOIN o ON l.o_custkey = o.o_custkey AND abs(day - other) <= 3 GROUP BY l_orderkey, day""",
    "stale_rows": "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR n_chars > 1000 + 2000 * quality",
    "summary_counts": f"SELECT rule, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings FROM ({LINE_RULES}) GROUP BY rule",
    "max_severity": f"SELECT l_suppkey, max(CASE severity WHEN 'error' THEN 2 ELSE 1 END) AS severity FROM ({LINE_RULES}) GROUP BY l_suppkey",
    "bounded_chain": """
SELECT l_suppkey, array_to_string(list_slice(p, 1, 8), ', ') || CASE WHEN len(p) > 8 THEN ' +' || (len(p) - 8) || ' more' ELSE '' END AS chain
FROM (SELECT l_suppkey, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY l_suppkey)""",
    "directive_scan": r"""
SELECT page_id, CAST(k - 1 AS INTEGER) AS ord, regexp_extract(c[k], '^(\S+)', 1) AS verb, trim(regexp_extract(c[k], '^\S+\s*(.*)$', 1)) AS argument
FROM (SELECT page_id, c, unnest(range(1, len(c) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<!--\s*(.*?)\s*-->', 1) AS c FROM pages))""",
    "fact_udtf": """
SELECT page_id, CAST(k - 1 AS INTEGER) AS ord, c[k] AS href
FROM (SELECT page_id, c, unnest(range(1, len(c) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS c FROM pages))""",
    "snippet_lookup": "SELECT doc_id, coalesce(nullif(trim(string_split(text, chr(10))[doc_id % 5 + 1], ' '), ''), lang) AS snippet FROM documents",
    "ngram_embedding": f"""
WITH t AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS p FROM documents WHERE text <> ''),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(p) - 2, 1) + 1), lambda i: list_slice(p, i, i + 2))) AS g FROM t),
b AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY doc_id, g),
h AS (SELECT g, CAST(({FNV.format(bytes="g")}) % 128 AS BIGINT) AS bucket FROM (SELECT DISTINCT g FROM b))
SELECT doc_id, bucket, CAST(sum(n) AS BIGINT) AS n FROM b JOIN h USING (g) GROUP BY 1, 2""",
    "report_json": f"""
WITH f AS ({LINE_RULES}), m AS (SELECT *, 'order ' || l_orderkey AS message FROM f)
SELECT '{{"column":1,"fingerprint":"' || {fnv_hex("concat_ws('|', rule, l_suppkey, l_linenumber, 1, message)")} || '","line":' || l_linenumber || ',"message":"' || message || '","path":"' || l_suppkey
  || '","rule":"' || rule || '","severity":"' || severity || '"}}' AS value FROM m""",
    "cosine_pairs": """
SELECT * FROM (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE similarity >= 0.30""",
    "mean_pool": """
SELECT label, CAST(k - 1 AS INTEGER) AS position, round(avg(embedding[k]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY label, k""",
    "doc_state_latest": """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'click', 'purchase'))
WHERE n = 1 AND event_type <> 'signup'""",
}

ORACLE["doc_state_stream"] = ORACLE["doc_state_latest"]
