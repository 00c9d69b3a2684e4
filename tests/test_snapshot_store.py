"""Snapshots in buckets: only touched buckets are written, commits are whole, retries change nothing."""

import pytest
from pyspark.sql import functions as F

from beaconry.operators import snapshot_store as store, snapshots
from tests.conftest import rows

SCHEMA = "identifier string, payload string, created_at bigint, content_hash string"
BUCKETS = 8


def entries(spark, *items):
    return spark.createDataFrame([(i, f"p-{h}", t, h) for i, t, h in items], SCHEMA)


def files(spark, path):
    """File names per bucket of the newest version."""
    out = {}
    for name in store.read(spark, path, SCHEMA).inputFiles():
        out.setdefault(name.split("bucket=")[1].split("/")[0], set()).add(name)
    return out


def bucket(spark, identifier):
    return str(spark.range(1).select(store.bucket_of(F.lit(identifier), BUCKETS).alias("b")).first().b)


def test_only_touched_buckets_get_new_files(spark, tmp_path):
    path = str(tmp_path / "snap")
    first = entries(spark, *[(f"u{n}", 10, "a") for n in range(60)])
    store.create(first, path, BUCKETS)
    before = files(spark, path)
    assert len(before) == BUCKETS
    fresh = entries(spark, ("u1", 11, "b"), ("u1", 12, "c"), ("u2", 9, "late"), (None, 3, "n"))
    assert store.commit_upsert(path, fresh, BUCKETS, "one") == 1
    after = files(spark, path)
    touched = {bucket(spark, i) for i in ("u1", "u2", None)}
    assert {b for b in after if after[b] != before[b]} == touched
    got = {r.identifier: r.content_hash for r in store.read(spark, path, SCHEMA).collect()}
    assert got["u1"] == "c" and got["u2"] == "a" and got[None] == "n" and len(got) == 61
    assert rows(store.buckets_written(spark, path), "version", "rewritten", "kept") == [
        (0, BUCKETS, 0), (1, len(touched), BUCKETS - len(touched)),
    ]
    # Older versions stay readable.
    assert {r.content_hash for r in store.read(spark, path, SCHEMA, version=0).collect()} == {"a"}


def test_commits_equal_plain_upserts(spark, tmp_path):
    path = str(tmp_path / "snap")
    items = [(f"u{(n * 7) % 23}", (n * 13) % 17, f"h{n % 5}") for n in range(200)]
    stored = snapshots.upsert(entries(spark), entries(spark, *items[:50]))
    store.create(stored, path, BUCKETS)
    for n, part in enumerate((items[50:90], [], items[90:91], items[91:])):
        fresh = entries(spark, *part)
        stored = snapshots.upsert(stored, fresh)
        store.commit_upsert(path, fresh, BUCKETS, f"b{n}")
    assert rows(store.read(spark, path, SCHEMA)) == rows(stored)


def test_failed_and_repeated_commits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    store.create(entries(spark, ("a", 1, "x"), ("b", 1, "x")), path, BUCKETS)
    fresh = entries(spark, ("a", 2, "y"), ("c", 2, "y"))
    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit_upsert(path, entries(spark, ("a", 2, "wrong"), ("d", 2, "wrong")), BUCKETS, "late")
    # Data was written, but nothing of it counts.
    assert rows(store.read(spark, path, SCHEMA), "identifier", "content_hash") == [("a", "x"), ("b", "x")]
    for _ in range(2):
        assert store.commit_upsert(path, fresh, BUCKETS, "late") == 1
    assert rows(store.read(spark, path, SCHEMA), "identifier", "content_hash") == [("a", "y"), ("b", "x"), ("c", "y")]


def test_empty_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    store.create(entries(spark), path, BUCKETS)
    assert store.read(spark, path, SCHEMA).count() == 0
    store.commit_upsert(path, entries(spark, ("a", 1, "x")), BUCKETS, "one")
    assert rows(store.read(spark, path, SCHEMA), "identifier") == [("a",)]
    with pytest.raises(ValueError):
        store.read(spark, path, SCHEMA, version=-1)
