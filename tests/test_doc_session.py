"""Sessions by arbitrary state: what is published, what state is left, restarts, and the time to live."""

import time

from orbweave.streaming import doc_session as ds

SCHEMA = "doc string, seq long, kind string, text string"
BATCHES = [
    [("a", 2, "change", "x2"), ("a", 1, "open", "x"), ("b", 3, "open", None), ("c", 4, "save", None), ("a", 5, "other", "?")],
    [("a", 6, "save", None), ("b", 7, "close", "gone"), ("b", 8, "save", None), (None, 9, "open", "n")],
    [("a", 10, "close", None), ("a", 11, "open", "again"), ("b", 12, "close", None), ("d", 13, "open", "d")],
    [("a", 14, "save", None), ("d", 15, "close", None)],
]


def expected(rows):
    shown, out = {}, []
    for doc, seq, kind, text in sorted(rows, key=lambda r: r[1]):
        if kind in ("open", "change"):
            shown[doc] = text
        elif kind == "close":
            shown.pop(doc, None)
        elif kind != "save" or doc not in shown:
            continue
        out.append((doc, seq, kind, shown.get(doc)))
    return out, shown


def run(spark, tmp_path, wait=lambda query: query.awaitTermination(), **options):
    events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "events"))
    wait(ds.publish(events, "doc", ["seq"], "text", str(tmp_path / "log"), str(tmp_path / "progress"), **options))


def test_every_batch_is_a_restart(spark, tmp_path):
    for k in range(len(BATCHES)):
        spark.createDataFrame(BATCHES[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        run(spark, tmp_path)
        want, shown = expected([r for b in BATCHES[: k + 1] for r in b])
        got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
        assert {r.doc: r.text for r in ds.open_documents(spark, str(tmp_path / "progress"), "doc", "text").collect()} == shown
    assert spark.conf.get(ds.STORE).endswith("HDFSBackedStateStoreProvider")


def until_done(query):
    for _ in range(60):  # such a stream has batches without events, so it is never at rest
        query.awaitTermination(0.5)
        if sum(p.numInputRows for p in query.recentProgress):
            break
    query.stop()


def test_untouched_documents_lose_their_state(spark, tmp_path):
    for k, rows in enumerate([[("a", 1, "open", "x")], [("a", 2, "save", None), ("b", 3, "open", "y")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(1.5 * k)
        run(spark, tmp_path, until_done, ttl_ms=1000, available_only=False)
    assert {r.seq for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {1, 3}  # nothing to save any more
