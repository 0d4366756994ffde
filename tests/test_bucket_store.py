"""Copy-on-write store: commits, failed batches, what is rewritten and read."""

import glob
import os

import pytest

from botsift.session import scratch_path
from botsift.sources import bucket_store as cow

SCHEMA = "user_id bigint, state string, label string, profile_json string"


def rows_of(spark, ids, label):
    return spark.createDataFrame([(i, "found", label, f'{{"id":{i}}}') for i in ids], SCHEMA)


def labels(df):
    return {r["user_id"]: (r["label"], r["version"]) for r in df.collect()}


def size(root, version):
    return sum(os.path.getsize(p) for p in glob.glob(f"{root.removeprefix('file:')}/data/version={version}/bucket=*/*.parquet"))


@pytest.fixture
def store(spark):
    root = scratch_path(spark, "t-cow")
    cow.upsert(rows_of(spark, range(2000), "human"), root, 1)
    return root


def test_an_upsert_rewrites_its_buckets_only(spark, store):
    touched = cow.upsert(rows_of(spark, [5, 5000], "bot"), store, 2)
    assert 1 <= len(touched) <= 2
    got = labels(cow.read(spark, store))
    assert got == {**{i: ("human", 1) for i in range(2000)}, 5: ("bot", 2), 5000: ("bot", 2)}
    m = {r["bucket"]: r for r in cow.manifest(spark, store).collect()}
    assert sorted(b for b, r in m.items() if r["written"] == 2) == touched and len(m) == cow.BUCKETS
    assert sum(r["n_rows"] for r in m.values()) == 2001
    assert size(store, 2) < size(store, 1) * 3 / cow.BUCKETS
    assert labels(cow.read(spark, store, version=1)) == {i: ("human", 1) for i in range(2000)}


def test_a_failed_batch_leaves_the_store_as_it_was(spark, store, monkeypatch):
    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(cow, "_commit", fail)
        with pytest.raises(OSError):
            cow.upsert(rows_of(spark, [1, 2, 3], "bot"), store, 2)
    assert cow.versions(spark, store) == [1]
    assert labels(cow.read(spark, store))[1] == ("human", 1)
    cow.upsert(rows_of(spark, [1], "bot"), store, 2)  # the batch again, now without 2 and 3
    got = labels(cow.read(spark, store))
    assert [got[i] for i in (1, 2, 3)] == [("bot", 2), ("human", 1), ("human", 1)] and len(got) == 2000


def test_a_lookup_opens_the_buckets_of_its_requests(spark, store):
    ids = spark.createDataFrame([(7,), (7,), (None,), (99999,)], "user_id bigint")
    got = cow.read(spark, store, ids)
    assert labels(got) == {7: ("human", 1)}
    opened = {f.split("bucket=")[1].split("/")[0] for f in got.inputFiles() if "bucket=" in f}
    wanted = {str(r[0]) for r in ids.filter("user_id IS NOT NULL").select(cow.bucket_of()).collect()}
    assert opened == wanted
    assert cow.read(spark, store, ids.limit(0)).count() == 0


def test_empty_null_and_repeated_rows(spark):
    root = scratch_path(spark, "t-cow-e")
    assert cow.read(spark, root).count() == 0 and cow.versions(spark, root) == []
    assert cow.upsert(spark.createDataFrame([], SCHEMA), root, 1) == []
    assert cow.read(spark, root).count() == 0
    twice = spark.createDataFrame([(1, "found", "bot", None), (1, "found", "human", None), (None, "found", "bot", None),
                                   (2, "missing", None, None)], SCHEMA)
    cow.upsert(twice, root, 2)
    assert labels(cow.read(spark, root)) == {1: ("human", 2), 2: (None, 2)}
    cow.upsert(spark.createDataFrame([], SCHEMA), root, 3)
    assert labels(cow.read(spark, root)) == {1: ("human", 2), 2: (None, 2)}


def test_versions_grow_and_the_width_is_kept(spark, store):
    with pytest.raises(ValueError):
        cow.upsert(rows_of(spark, [1], "bot"), store, 1)
    with pytest.raises(ValueError):
        cow.upsert(rows_of(spark, [1], "bot"), store, 2, buckets=8)
    with pytest.raises(ValueError):
        cow.read(spark, store, version=9)
