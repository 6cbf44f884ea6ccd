"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries: a pattern (a host or a domain) was added to or removed from
the block or the allow list on a day. Entries become validity intervals; a capture is judged by
the entries active at its fetch time. The as-of join asks about each pattern and day once, however many
captures there are of it: days asked about and intervals are sorted together along a pattern, and the last
interval is carried forward. A pattern has as many rows as days and entries, so a host that holds a third of
the captures is no large window; its captures then meet the answers by pattern and day, which Spark splits.

Of the active patterns that match, the longest decides; on equal length allow beats block.

Defined results: a null URL or one without a host, and a null fetch time, match nothing and are
not blocked; hosts are compared in lower case, without port, user or a closing dot; entries with
equal pattern, list and day apply in the order add, remove; a removal without an addition, and
repeated entries, change nothing; an empty list blocks nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.joins import asof_latest


def host_of(url: Column) -> Column:
    """The lower-case host of an http(s) URL; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def suffixes(host: Column) -> Column:
    """A host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.when(host != "", F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, list, since, until) of entries (pattern, list, action, day); until is open or null."""
    order = Window.partitionBy("pattern", "list").orderBy("day", "action")
    return (
        entries.select(F.lower("pattern").alias("pattern"), "list", "action", "day").filter("day is not null")
        .withColumn("until", F.lead("day").over(order))
        .filter("action = 'add' and (until is null or until > day)")
        .select("pattern", "list", F.col("day").alias("since"), "until")
    )


def active(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, day, best) of asked (key, day) where an entry is active: size, allowed, since and pattern of the one that decides."""
    valid = intervals(entries).withColumnRenamed("pattern", "key")
    # a list's intervals are apart, so the last one that has begun is the only one that can hold
    each = asked.select("key", F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("list"), F.col("day").alias("at"))
    last = asof_latest(each, valid.withColumn("at", F.col("since")), ["key", "list"], "at", [], ["since", "until"])
    holds = F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    return last.filter(holds).groupBy("key", F.col("at").alias("day")).agg(F.max(F.struct(
        F.length("key").alias("size"), (F.col("list") == "allow").alias("allowed"), "since", F.col("key").alias("pattern"))).alias("best"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with host, rule, rule_list, rule_since and blocked."""
    rows = (captures.select(F.monotonically_increasing_id().alias("rid"), "page_id", host_of(F.col("url")).alias("host"), F.to_date("day").alias("day"))
            .withColumn("key", F.explode_outer(suffixes(F.col("host")))))
    asked = rows.select("key", "day").filter("key is not null and day is not null").distinct()
    return rows.join(active(asked, entries), ["key", "day"], "left").groupBy("rid", "page_id", "host", "day").agg(F.max("best").alias("best")).select(
        "page_id", "host", "day", F.col("best.pattern").alias("rule"),
        F.when(F.col("best.allowed"), "allow").when(~F.col("best.allowed"), "block").alias("rule_list"),
        F.col("best.since").alias("rule_since"), F.coalesce(~F.col("best.allowed"), F.lit(False)).alias("blocked"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """The synthetic pages with a fetch day in 2024, as the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(366)).cast("int")).alias("day"))


def derived_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages: some hosts are added, removed, added again, or allowed."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct()
    byte = lambda k: F.conv(F.substring(F.md5("pattern"), k, 2), 16, 10).cast("int")
    day = lambda offset: F.date_add(F.lit("2023-12-01").cast("date"), offset.cast("int"))
    entry = lambda pattern, kind, action, when: F.struct(
        pattern.alias("pattern"), F.lit(kind).alias("list"), F.lit(action).alias("action"), when.alias("day"))
    parent = F.regexp_replace("pattern", r"^[^.]+\.", "")
    first, second = byte(3), byte(3) + 1 + byte(5)
    log = F.when(byte(1) % 4 == 0, F.array(
        entry(F.col("pattern"), "block", "add", day(first)), entry(F.col("pattern"), "block", "remove", day(second)),
        entry(F.col("pattern"), "block", "add", day(second + 30))),
    ).when(byte(1) % 4 == 1, F.array(entry(parent, "block", "add", day(first)), entry(F.col("pattern"), "allow", "add", day(second))))
    return hosts.select(F.explode(log).alias("e")).select("e.*").distinct()


ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, DATE '2024-01-01' + CAST(coalesce(page_id, 0) % 366 AS INTEGER) AS day,
  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host FROM pages),
h AS (SELECT DISTINCT host AS pattern, regexp_replace(host, '^[^.]+\.', '') AS parent,
  CAST('0x' || substr(md5(host), 1, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(host), 3, 2) AS INTEGER) AS b,
  CAST('0x' || substr(md5(host), 5, 2) AS INTEGER) AS c FROM p WHERE host <> ''),
e AS (SELECT pattern, 'block' AS list, 'add' AS action, DATE '2023-12-01' + b AS day FROM h WHERE a % 4 = 0
  UNION SELECT pattern, 'block', 'remove', DATE '2023-12-01' + (b + 1 + c) FROM h WHERE a % 4 = 0
  UNION SELECT pattern, 'block', 'add', DATE '2023-12-01' + (b + 31 + c) FROM h WHERE a % 4 = 0
  UNION SELECT parent, 'block', 'add', DATE '2023-12-01' + b FROM h WHERE a % 4 = 1
  UNION SELECT pattern, 'allow', 'add', DATE '2023-12-01' + (b + 1 + c) FROM h WHERE a % 4 = 1),
s AS (SELECT *, lead(day) OVER (PARTITION BY pattern, list ORDER BY day, action) AS until FROM e),
v AS (SELECT pattern, list, day AS since, until FROM s WHERE action = 'add' AND (until IS NULL OR until > day)),
m AS (SELECT p.rid, v.*, row_number() OVER (PARTITION BY p.rid ORDER BY length(v.pattern) DESC, v.list = 'allow' DESC, v.since DESC) AS n
  FROM p JOIN v ON (p.host = v.pattern OR ends_with(p.host, '.' || v.pattern)) AND v.since <= p.day AND (v.until IS NULL OR p.day < v.until))
SELECT p.page_id, p.host, p.day, m.pattern AS rule, m.list AS rule_list, m.since AS rule_since, coalesce(m.list = 'block', false) AS blocked
FROM p LEFT JOIN m ON p.rid = m.rid AND m.n = 1
"""
