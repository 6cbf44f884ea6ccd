"""The facts cache: unchanged runs write nothing, broken writers change nothing, old snapshots go."""

import pytest

from orbweave.sources import cache

SCHEMA = "path string, fingerprint string, facts string, version string"


def rows(spark, *entries):
    return spark.createDataFrame([(*e, "1") for e in entries], SCHEMA)


def there(spark, path):
    return sorted((r.path, r.fingerprint, r.facts) for r in cache.load(spark, path, SCHEMA, "1").collect())


def test_store_skip_prune_and_clean_up(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert there(spark, path) == []
    assert cache.store(rows(spark, ("a", "f", "x"), ("b", "g", "y")), path)
    first = cache.snapshots(spark, path)
    assert not cache.store(rows(spark, ("b", "g", "y"), ("a", "f", "x")), path) and cache.snapshots(spark, path) == first
    assert cache.store(rows(spark, ("a", "f", "x")), path) and there(spark, path) == [("a", "f", "x")]  # b is pruned
    assert cache.store(rows(spark, ("a", "f2", "z")), path) and there(spark, path) == [("a", "f2", "z")]
    assert len(cache.snapshots(spark, path)) == 2 and first[0] not in cache.snapshots(spark, path)
    assert cache.load(spark, path, SCHEMA, "2").count() == 0
    assert cache.store(rows(spark), path) and there(spark, path) == []


def test_a_writer_that_dies_leaves_the_last_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    cache.store(rows(spark, ("a", "f", "x")), path)
    with monkeypatch.context() as patch:
        patch.setattr(cache, "_put_manifest", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            cache.store(rows(spark, ("a", "f9", "new")), path)
    assert there(spark, path) == [("a", "f", "x")] and len(cache.snapshots(spark, path)) == 2
    assert cache.store(rows(spark, ("a", "f3", "w")), path) and there(spark, path) == [("a", "f3", "w")]
    assert len(cache.snapshots(spark, path)) == 2


def test_broken_caches_are_empty(spark, tmp_path):
    path = tmp_path / "cache"
    cache.store(rows(spark, ("a", "f", "x")), str(path))
    (path / cache.MANIFEST).write_text("{broken")
    assert there(spark, str(path)) == [] and cache.store(rows(spark, ("a", "f", "x")), str(path)) and there(spark, str(path)) == [("a", "f", "x")]
    (tmp_path / "file").write_text("no folder")
    with pytest.warns(UserWarning):
        assert not cache.store(rows(spark, ("a", "f", "x")), str(tmp_path / "file"))
