"""Merged types of orders without lines, status or customer, beside the query's SQL."""

import duckdb

from __spark_entry__ import ORACLE, QUERIES


def test_types_without_names_in_their_sets(spark, tmp_path):
    orders = [(1, 7, "1-URGENT", "F"), (2, 7, "5-LOW", "O"), (3, 8, "2-HIGH", "P"), (4, 9, None, None), (5, None, "5-LOW", "O"), (6, None, "3-MEDIUM", "F"), (7, 10, "5-LOW", "")]
    lines = [(1, 2, "R"), (1, 10, "A"), (2, 2, "N"), (4, 1, None), (6, 3, "R"), (99, 5, "R"), (None, 6, "A")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in QUERIES["merged_types"](spark, str(tmp_path)).collect()}
    assert got == {
        ("7", True, 2, "10,2", "F,O", "A,N,R"), ("8", False, 1, None, "P", None), ("9", None, 0, "1", None, None), (None, False, 2, "3", "F,O", "R"), ("10", None, 1, None, "", None)}
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert got == set(con.sql(ORACLE["merged_types"]).fetchall())
