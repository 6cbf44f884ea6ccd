"""Rows that explode to many must not be broadcast: innermost intervals where no broadcast has room."""

from __spark_entry__ import QUERIES
from orbweave.operators.intervals import innermost


def test_nothing_is_broadcast(spark):
    room = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(room, "1")
    try:
        points = spark.range(200).selectExpr("'a' as key", "id as name", "cast(id as int) as at")
        spans = spark.range(100).selectExpr("'a' as key", "id as span", "cast(id as int) as b", "cast(200 - id as int) as e")
        got = {r.name: r.span for r in innermost(points, spans, ["key"], "name", "at", "span", "b", "e").collect()}
        assert got == {n: min(n, 200 - n, 99) for n in range(200)}
        got = {r.name: r.span for r in innermost(points, spans, ["key"], "name", "at", "span", "b", "e", True).collect()}
        assert got == {n: min(n, 200 - n, 99) - (n < 100) for n in range(1, 200)}
        assert QUERIES["innermost_interval"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset(room)


def test_bounds_beyond_the_spans_change_nothing(spark):
    points = spark.range(-50, 250).selectExpr("'a' as key", "id as name", "cast(id as int) as at")
    spans = spark.range(100).selectExpr("'a' as key", "id as span", "cast(id - 20 as int) as b", "cast(180 - id as int) as e")
    found = lambda bounds: sorted(map(tuple, innermost(points, spans, ["key"], "name", "at", "span", "b", "e", True, bounds).collect()))
    assert found(None) == found((-20, 180)) == found((-1000, 1_000_000)) != []


def test_orders_that_were_all_shipped_before(spark, tmp_path):
    spark.sql("select id as o_orderkey, 7L as o_custkey, timestamp'2024-05-05 00:00:00' as o_orderdate from range(5)").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("select id as l_orderkey, timestamp'2024-05-04 00:00:00' as l_shipdate from range(5)").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert QUERIES["innermost_interval"](spark, str(tmp_path)).collect() == []
