"""The generic operators applied to the test tables, one query for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import hashing, vectors
from orbweave.operators import graph, intervals, joins, suppression
from orbweave.plans.table_rules import TableRule, deinit_only_release, evaluate, reachable_release

EXCLUDES = ("/fr/", "page=2", "m.th")
BUDGET_CHARS = 2000
CONTRACTS = [
    (0, "SMALL", None, ["BRUSHED"], "tokenProducer"), (1, "SMALL", "Brand#1", [], "sinkWrapper"),
    (2, "STANDARD", None, [], "tokenProducer"), (3, "SMALL", None, [], "tokenProducer"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as nested release sites."""
    sites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(
        F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "F").alias("in_deinit"))).alias("release_sites"))
    empty = F.array().cast("array<struct<kind:string,in_deinit:boolean>>")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(sites, "o_orderkey", "left").withColumn("release_sites", F.coalesce("release_sites", empty))


def rule_severity_upgrade(spark, sf_dir):
    sites = F.col("release_sites")
    severity = F.when(deinit_only_release(sites, "R"), "error").otherwise("warning")
    return typed_orders(spark, sf_dir).filter(~reachable_release(sites, "R")).select("o_orderkey", severity.alias("severity"))


def line_rules() -> list[TableRule]:
    return [
        TableRule("deep-discount", F.col("l_discount") >= 0.08), TableRule("returned-taxed", (F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05), "error"),
        TableRule("bulk", F.col("l_quantity") > 45), TableRule("cheap", F.col("l_extendedprice") < 1500, enabled=False),
    ]


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def rule_union(spark, sf_dir):
    return evaluate(table(spark, sf_dir, "lineitem"), line_rules(), LINE)


OVERRIDES = {"bulk": {"enabled": False}, "cheap": {"enabled": True, "severity": "error"}, "deep-discount": {"severity": "error"}}


def rule_config_override(spark, sf_dir):
    return evaluate(table(spark, sf_dir, "lineitem"), line_rules(), LINE, OVERRIDES)


def reference_gate_null(spark, sf_dir):
    flagged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag")), "doc_id", "left")
    return flagged.groupBy("source").agg(
        F.count_if(F.coalesce("flag", F.lit(False))).alias("surely"), F.count_if(F.coalesce("flag", F.lit(True))).alias("possibly"), F.count_if(F.col("flag").isNull()).alias("unknown"))


def exclude_filter(spark, sf_dir):
    from orbweave.sources.files import not_excluded

    return table(spark, sf_dir, "pages").filter(not_excluded(F.col("url"), EXCLUDES)).select("page_id", "url")


def bounded_scan(spark, sf_dir):
    over = F.col("n_chars") > BUDGET_CHARS
    return table(spark, sf_dir, "documents").select("doc_id", F.when(over, "degraded").otherwise("ok").alias("status"), F.when(~over, F.octet_length("text")).alias("bytes"))


def _event_lines(spark, sf_dir):
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), line.alias("line"), "event_id", "event_type")


def _event_findings(spark, sf_dir):
    return _event_lines(spark, sf_dir).filter(F.col("event_type").isin("view", "error")).select("path", "line", "event_id", F.col("event_type").alias("rule"))


def _event_directives(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "signup", "disable").when(F.col("event_type") == "purchase", "enable")
    rules = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("view"))).otherwise(F.array().cast("array<string>"))
    return _event_lines(spark, sf_dir).select("path", F.col("event_id").alias("ord"), "line", kind.alias("kind"), rules.alias("rules"), F.concat(F.lit("reason "), F.col("event_id").cast("string")).alias("reason")).filter("kind is not null")


def suppression_accept(spark, sf_dir):
    return suppression.accepted(_event_findings(spark, sf_dir), _event_directives(spark, sf_dir)).select("event_id", "accepted", "accept_reason")


def suppression_region(spark, sf_dir):
    return suppression.in_region(_event_findings(spark, sf_dir), _event_directives(spark, sf_dir), ["view", "error"]).select("event_id", "region")


def suppression_full(spark, sf_dir):
    return suppression.suppress(_event_findings(spark, sf_dir), _event_directives(spark, sf_dir), ["view", "error"]).select("event_id", "path", "line", "status")


def fingerprint_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.content_fingerprint(F.col("text"), "salt").alias("fingerprint"))


def _order_print(df):
    return df.withColumn("fingerprint", hashing.finding_fingerprint(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey"), F.to_date("o_orderdate")))


def fingerprint_finding(spark, sf_dir):
    return _order_print(table(spark, sf_dir, "orders")).select("o_orderkey", "fingerprint")


def _baseline(spark, sf_dir):
    orders = _order_print(table(spark, sf_dir, "orders"))
    known = orders.filter("o_orderkey % 2 = 0").select("fingerprint")
    return joins.split_known(orders, known, "fingerprint")


def baseline_kept(spark, sf_dir):
    return _baseline(spark, sf_dir)[0].select("o_orderkey", "fingerprint")


def baseline_matched(spark, sf_dir):
    return _baseline(spark, sf_dir)[1].select("o_orderkey", "fingerprint")


def cache_probe(spark, sf_dir):
    from orbweave.sources.cache import probe

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("fingerprint"), "source")
    edited = F.when(F.col("path") % 10 == 0, F.md5(F.concat("fingerprint", F.lit("edited")))).otherwise(F.col("fingerprint"))
    snapshot = docs.filter("path % 7 <> 0").select("path", edited.alias("fingerprint"), F.length("source").alias("facts"))
    probed = probe(docs, snapshot)
    return probed.groupBy("source").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum("facts").alias("facts"))


def _references(spark, sf_dir):
    """Suppliers refer to those that ship a part after them; a part of them are unknown names."""
    lines = table(spark, sf_dir, "lineitem")
    along = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return lines.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(along).alias("dst"), "l_shipdate", "l_orderkey", "l_linenumber").filter("dst is not null")


def _known_suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("name"))


def ownership_edges(spark, sf_dir):
    return graph.resolve_references(_references(spark, sf_dir), _known_suppliers(spark, sf_dir))[0].select("src", "dst").distinct()


def unresolved_refs(spark, sf_dir):
    return graph.resolve_references(_references(spark, sf_dir), _known_suppliers(spark, sf_dir))[1].groupBy("dst").count().withColumnRenamed("count", "n")


def first_edge_per_pair(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_shipdate", "l_orderkey", "l_linenumber")
    return graph.first_edges(lines, ["l_shipdate", "l_orderkey", "l_linenumber"])


def _next_users(spark, sf_dir, *kinds):
    """(src, dst, *kinds): the user of each event and of the next one in time that agrees in kinds.

    The next event is found day by day, and the last of a day looks at the next day's first, so that no
    window holds more than a day; the days themselves are few.
    """
    keys = [*kinds, "day"]
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", *kinds, F.to_date("ts").alias("day"))
    within = Window.partitionBy(*keys).orderBy("ts", "event_id")
    firsts = events.groupBy(*keys).agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("next_first"))
    follows = firsts.withColumn("next_first", F.lead("next_first").over(Window.partitionBy(*kinds).orderBy("day")))
    led = events.withColumn("dst", F.lead("user_id").over(within)).join(follows, keys, "left")
    return led.select(F.col("user_id").alias("src"), F.coalesce("dst", "next_first").alias("dst"), *kinds).filter("dst is not null and src <> dst")


def event_edges(spark, sf_dir):
    """Each event points from its user to the user of the next event in time."""
    return _next_users(spark, sf_dir).distinct()


def _cycle_lengths(edges):
    edges = graph.keep(edges)
    return graph.component_cycles(edges, graph.strong_components(edges)).select("component", F.size("path").alias("length"))


def scc_components(spark, sf_dir):
    return graph.strong_components(event_edges(spark, sf_dir))


def shortest_cycle_len(spark, sf_dir):
    return _cycle_lengths(event_edges(spark, sf_dir))


def mutual_cycles(spark, sf_dir):
    """Each component's cycle, at most eight links in words."""
    edges = graph.keep(event_edges(spark, sf_dir))
    shown = F.array_join(F.transform(F.slice("path", 1, 8), lambda x: x.cast("string")), " -> ")
    more = F.when(F.size("path") > 8, F.concat(F.lit(" +"), (F.size("path") - 8).cast("string"), F.lit(" more"))).otherwise("")
    return graph.component_cycles(edges, graph.strong_components(edges)).select("component", F.concat(shown, more).alias("cycle"))


def _expansion_seeds(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value >= 199.5").select(F.col("user_id").alias("name"))


def external_expansion(spark, sf_dir):
    return graph.reachable(event_edges(spark, sf_dir), _expansion_seeds(spark, sf_dir))


def mutual_pairs(spark, sf_dir):
    edges = _next_users(spark, sf_dir, "event_type").select("src", "dst").distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").filter("src < dst")


def strongest_capture(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).when(F.col("l_linestatus") == "O", 1).otherwise(0)
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", rank.alias("rank"), (F.col("l_discount") > 0.04).alias("nested_only"))
    return ranked.groupBy("l_orderkey").agg(F.max("rank").alias("strongest"), F.bool_and(F.when(F.col("rank") == 3, F.col("nested_only"))).alias("nested_only"))


FINITE, INFINITE, SUBJECT = ("BRUSHED", "PLATED"), ("POLISHED",), ("ECONOMY",)


def _upstream(words):
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
    return F.when(has(FINITE), "finite").when(has(INFINITE) | has(SUBJECT), "infinite").otherwise("unknown")


def upstream_class(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _upstream(F.split(F.upper("p_type"), r"\s+")).alias("upstream"))


def upstream_resolve(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", _upstream(F.split(F.upper("p_type"), r"\s+")).alias("upstream"))
    published = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("published", F.lit(True))
    return parts.join(published, "p_partkey", "left").select("p_partkey", F.when((F.col("upstream") == "unknown") & F.col("published"), "infinite").otherwise(F.col("upstream")).alias("upstream"))


def contract_first_match(spark, sf_dir):
    words = F.split(F.upper("p_type"), r"\s+")
    calls = table(spark, sf_dir, "part").select("p_partkey", words[0].alias("callee"), F.col("p_brand").alias("base"), words.alias("labels"))
    contracts = spark.createDataFrame(CONTRACTS, "ord int, callee string, base string, required array<string>, template string")
    return joins.first_match(calls, F.broadcast(contracts), "p_partkey")


def local_escape(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    uses = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("uses"))
    return uses.select("l_orderkey", "l_suppkey", F.when(F.col("uses") > 1, "escaping").otherwise("local-only").alias("consumption"))


def innermost_interval(spark, sf_dir):
    """The shortest other order of the customer that was open, up to its last shipment, when an order was placed."""
    day = lambda c: F.unix_date(F.to_date(c))
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("begin")), table(spark, sf_dir, "lineitem")
    ends = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(day(F.max("l_shipdate")).alias("end"))
    spans = orders.hint("merge").join(ends, "o_orderkey").select(F.col("o_orderkey").alias("span_key"), "o_custkey", F.col("begin").alias("span_begin"), F.col("end").alias("span_end"))
    first, last = orders.agg(F.min("begin")).first()[0], lines.agg(day(F.max("l_shipdate"))).first()[0]
    bounds = None if first is None or last is None or last < first else (first, last)
    return intervals.innermost(orders, spans, ["o_custkey"], "o_orderkey", "begin", "span_key", "span_begin", "span_end", apart=True, bounds=bounds)


def nearest_within(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("near_key"), F.unix_date(F.to_date("o_orderdate")).alias("other"))
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.unix_date(F.to_date("l_shipdate")).alias("day")).distinct().join(owner, "l_orderkey")
    near = joins.band_join(lines, orders, ["o_custkey"], "day", "other", 3)
    return joins.best_match(near, ["l_orderkey", "day"], F.struct(F.abs(F.col("day") - F.col("other")), "other", "near_key"), ["near_key", "other"])


def stale_rows(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").filter(F.col("quality").isNull() | (F.col("n_chars") > 1000 + 2000 * F.col("quality"))).select("doc_id")


def summary_counts(spark, sf_dir):
    found = rule_union(spark, sf_dir)
    return found.groupBy("rule").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def max_severity(spark, sf_dir):
    rank = F.when(F.col("severity") == "error", 2).otherwise(1)
    return rule_union(spark, sf_dir).groupBy("l_suppkey").agg(F.max(rank).alias("severity"))


def bounded_chain(spark, sf_dir):
    """At most eight names and how many more; the names beyond never leave the map side's aggregate."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    order = Window.partitionBy("l_suppkey").orderBy("l_partkey")
    top = pairs.withColumn("k", F.row_number().over(order)).groupBy("l_suppkey").agg(
        F.array_sort(F.collect_list(F.when(F.col("k") <= 8, F.col("l_partkey")))).alias("first"), F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > 8, F.concat(F.lit(" +"), (F.col("n") - 8).cast("string"), F.lit(" more"))).otherwise("")
    return top.select("l_suppkey", F.concat(F.array_join(F.transform("first", lambda x: x.cast("string")), ", "), more).alias("chain"))


def directive_scan(spark, sf_dir):
    comments = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<!--\s*(.*?)\s*-->"), 1)).alias("ord", "comment"))
    return comments.select("page_id", "ord", F.regexp_extract("comment", r"^(\S+)", 1).alias("verb"), F.trim(F.regexp_extract("comment", r"^\S+\s*(.*)$", 1)).alias("argument"))


def fact_udtf(spark, sf_dir):
    anchors = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("ord", "href"))
    return anchors


def snippet_lookup(spark, sf_dir):
    line = F.get(F.split("text", "\n"), F.pmod("doc_id", F.lit(5)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.when(F.trim(line) != "", F.trim(line)), F.col("lang")).alias("snippet"))


def ngram_embedding(spark, sf_dir):
    """Histogram of hashed three-letter sequences over whole texts, one row a bucket."""
    return vectors.ngram_histogram(table(spark, sf_dir, "documents"), "doc_id", "text")


def cosine_pairs(spark, sf_dir):
    similar = vectors.similar_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.30)
    return similar.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"), "similarity")


def mean_pool(spark, sf_dir):
    return vectors.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "position", F.round("mean", 6).alias("mean"))


def leader_clusters(spark, sf_dir):
    from orbweave.operators.rank import leader_clusters as clusters

    return clusters(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.2)


def doc_state_latest(spark, sf_dir):
    """The last open or change of each user that no close followed."""
    kind = F.when(F.col("event_type") == "signup", "close").when(F.col("event_type").isin("click", "purchase"), "change")
    events = table(spark, sf_dir, "events").withColumn("kind", kind).filter("kind is not null")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "kind", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.filter("e.kind = 'change'").select("user_id", "e.event_id", "e.value")


def doc_state_stream(spark, sf_dir):
    """doc_state_latest by a stream that keeps the latest event of each user and logs what changed."""
    from orbweave.operators.graph import keep
    from orbweave.streaming.doc_state import current, follow

    keep(spark.range(0))  # makes sure that a shared folder is set
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/doc-state-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    kind = F.when(F.col("event_type") == "signup", "close").when(F.col("event_type").isin("click", "purchase"), "change")
    # a stream reads a folder or a pattern, and the table may be one file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")
    events = stream.withColumn("kind", kind).filter("kind is not null")
    key, order, values = "user_id", ["ts", "event_id"], ["kind", "value"]
    follow(events, key, order, values, f"{folder}/log", f"{folder}/progress").awaitTermination()
    return current(spark, f"{folder}/log", key, order, values).filter("kind = 'change'").select("user_id", "event_id", "value")


def report_json(spark, sf_dir):
    from orbweave.operators.report import finding_json

    return finding_json(rule_union(spark, sf_dir).select("rule", "severity", F.col("l_suppkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.lit(1).alias("col"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("message"), F.lit(None).cast("string").alias("note")))


QUERIES = {f.__name__: f for f in (
    rule_severity_upgrade, rule_union, rule_config_override, reference_gate_null, exclude_filter, bounded_scan, suppression_accept,
    suppression_region, suppression_full, fingerprint_bytes, fingerprint_finding, baseline_kept, baseline_matched, cache_probe, ownership_edges,
    unresolved_refs, first_edge_per_pair, scc_components, shortest_cycle_len, mutual_cycles,
    external_expansion, mutual_pairs, strongest_capture,
    upstream_class, upstream_resolve, contract_first_match, local_escape, innermost_interval, nearest_within, stale_rows, summary_counts, max_severity,
    bounded_chain, directive_scan, fact_udtf, snippet_lookup, ngram_embedding, cosine_pairs, mean_pool, leader_clusters, doc_state_latest, doc_state_stream, report_json,
)}
