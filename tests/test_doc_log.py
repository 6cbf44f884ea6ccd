"""The log of a stream over several batches: saves send again, closes leave tombstones."""

from orbweave.streaming import doc_state

SCHEMA = "doc string, seq long, kind string, text string"


def test_log(spark, tmp_path):
    batches = [[("a", 1, "open", "x"), ("b", 2, "open", "y"), ("c", 3, "save", None)], [("a", 4, "save", None)], [("b", 5, "close", "gone"), ("a", 6, "change", "z")], [("b", 7, "save", None)]]
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "events"))
        doc_state.publish(events, "doc", ["seq"], "text", str(tmp_path / "log"), str(tmp_path / "progress")).awaitTermination()
        seen.append(sorted((r.doc, r.kind, r.text) for r in spark.read.parquet(str(tmp_path / "log" / f"batch={k}")).collect()))
    assert seen == [[("a", "open", "x"), ("b", "open", "y")], [("a", "open", "x")], [("a", "change", "z"), ("b", "close", None)], [("b", "close", None)]]
    last = {r.doc: (r.kind, r.text) for r in doc_state.published(spark, str(tmp_path / "log"), "doc", ["seq"], "text").collect()}
    assert last == {"a": ("change", "z"), "b": ("close", None)}
