"""Labelled file, status JSON and profile store round trips."""

import json

import pytest
from pyspark.sql import functions as F

from botsift.session import scratch_path
from botsift.sources import labelled as lb
from botsift.sources import profile_store as ps


def write_text(spark, lines):
    path = scratch_path(spark, "t-lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_labelled_golden_lines(spark):
    path = write_text(spark, ["bot 12 3 4", "human 7", "bot x 3", "", "bot 1  2", "human 5 1 2 "])
    acc, bad = lb.read_labelled(spark, path)
    got = {r["user_id"]: (r["label"], r["status_ids"]) for r in acc.collect()}
    assert got == {12: ("bot", [3, 4]), 7: ("human", []), 5: ("human", [1, 2])}  # G-q, G-s, T10
    bad_rows = bad.collect()
    assert sorted(r["reason"] for r in bad_rows) == ["blank", "empty_token", "non_numeric"]  # G-r
    recs = {r["line"]: r["location"]["rec"] for r in bad_rows}  # one split: record = line index
    assert recs == {"bot x 3": 2, "": 3, "bot 1  2": 4}


def test_labelled_failfast(spark):
    path = write_text(spark, ["bot 12 3", "bot x 3"])
    acc, _ = lb.read_labelled(spark, path, mode="failfast")
    with pytest.raises(Exception, match="malformed"):
        acc.collect()


def test_first_ten_listed(spark):
    path = write_text(spark, ["bot 1 " + " ".join(str(i) for i in range(100, 112))])
    acc, _ = lb.read_labelled(spark, path)
    row = lb.first_listed(acc).collect()[0]
    assert row["status_ids"] == list(range(100, 110))  # G-t


def test_store_latest_version_and_lookup(spark):
    root = scratch_path(spark, "t-store")
    v1 = spark.createDataFrame([(1, "found", "human", "{}"), (2, "missing", None, None)],
                               "user_id long, state string, label string, profile_json string")
    v2 = spark.createDataFrame([(1, "found", "bot", "{}")],
                               "user_id long, state string, label string, profile_json string")
    ps.write_version(v1, root, 1)
    ps.write_version(v2, root, 2)
    with pytest.raises(ValueError, match="already there"):
        ps.write_version(v1, root, 2)  # a version is never replaced
    store = ps.read_store(spark, root)
    got = {r["user_id"]: (r["label"], r["version"]) for r in store.collect()}
    assert got == {1: ("bot", 2), 2: (None, 1)}  # G-o (last wins), V16 (null stays null)
    req = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    states = {r["user_id"]: r["state"] for r in ps.lookup(req, store).collect()}
    assert states == {1: "found", 2: "missing", 3: "unseen"}


def test_status_json_permissive(spark):
    path = scratch_path(spark, "t-json")
    good = {"id": 5, "created_at": "Mon Jan 01 00:00:07 +0000 2024", "source": "web",
            "entities": {"urls": [{"url": "a", "expanded_url": "b"}], "hashtags": ["x", "y"]},
            "user": {"id": 9, "screen_name": "n"}}
    no_user = {"id": 6, "created_at": "Mon Jan 01 00:00:07 +0000 2024"}
    bad_time = {**good, "id": 7, "created_at": "yesterday"}
    spark.createDataFrame([(json.dumps(good),), (json.dumps(no_user),), ("{broken",), (json.dumps(bad_time),)], "value string") \
        .coalesce(1).write.text(path)
    from botsift.sources.status_json import read_status_json

    rows = read_status_json(spark, path).collect()
    assert len(rows) == 2
    r, no_time = sorted(rows, key=lambda r: r["status_id"])
    assert (no_time["status_id"], no_time["created_ms"]) == (7, None)  # not a time: the post stays
    assert (r["status_id"], r["user_id"], r["created_ms"]) == (5, 9, 1704067207000)
    assert (r["n_urls"], r["n_hashtags"], r["n_mentions"]) == (1, 2, 0)


def test_scratch_paths_are_fresh(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b


def test_profile_json_roundtrip_keeps_raw(spark, sf_small):
    from botsift.operators import features as fx
    from botsift.operators import timeline as tl
    from botsift.sources import fixtures as fix

    users, st = fix.users(spark, sf_small), fix.statuses(spark, sf_small)
    training = st.filter("status_id % 50 = 0").withColumn("owner", F.col("user_id"))
    seen = tl.timeline(st, users)
    docs = ps.encode_profiles(users, fx.user_features(users, st), training).unionByName(ps.encode_timelines(seen))
    back = ps.decode_profiles(docs.select(F.col("profile_json").alias("value")))
    sent = docs.select("user_id", "chunk", "raw")
    assert back.select("user_id", "chunk", "raw").exceptAll(sent).count() == 0 and back.count() == sent.count()
    assert back.filter("chunk IS NULL").count() == users.count()
    assert back.select(F.explode("timeline_ids")).count() == seen.count()
    assert back.select(F.explode("training_ids")).count() == training.join(users, "user_id").count()
    one = sent.filter("chunk IS NOT NULL").first()["raw"][0]
    assert {"id", "created_ms", "source", "text"} <= json.loads(one).keys()


def test_duplicate_ids_last_line_wins(spark):
    path = write_text(spark, ["human 7 1", "bot 8 2", "bot 7 3"])
    acc, _ = lb.read_labelled(spark, path)
    got = {r["user_id"]: (r["label"], r["status_ids"]) for r in lb.dedupe_accounts(acc).collect()}
    assert got == {7: ("bot", [3]), 8: ("bot", [2])}  # G-o


def test_decode_drops_undecodable_profiles(spark):
    docs = spark.createDataFrame(
        [('{"user_id": 5, "label": "bot", "marshalledUser": "{\\"id\\": 5, \\"screen_name\\": \\"a\\"}", '
          '"marshalledUserTimeline": []}',), ("{not json",)], "value string")
    rows = ps.decode_profiles(docs).collect()  # A5: an undecodable entry is dropped
    assert [(r["user_id"], r["label"]) for r in rows] == [(5, "bot")]


def test_store_compaction(spark):
    root = scratch_path(spark, "t-store-c")
    schema = "user_id long, state string, label string, profile_json string"
    ps.write_version(spark.createDataFrame([(1, "found", "human", "{}"), (2, "found", "bot", "{}")], schema), root, 1)
    ps.write_version(spark.createDataFrame([(1, "found", "bot", "{}")], schema), root, 2)
    assert ps.compact_store(spark, root) == 2
    ps.write_version(spark.createDataFrame([(2, "missing", None, None)], schema), root, 3)
    got = {r["user_id"]: (r["state"], r["label"], r["version"]) for r in ps.read_store(spark, root).collect()}
    assert got == {1: ("found", "bot", 2), 2: ("missing", None, 3)}


def test_a_shared_post_has_one_owner_and_an_account_one_label(spark):
    from botsift.operators import resolve

    path = write_text(spark, ["bot 7 1 2", "human 8 2 3", "human 7 2 4", "bot 9 2 5"])
    acc, _ = lb.read_labelled(spark, path)
    st = spark.createDataFrame([(i, 70 + i, 0, "web") for i in (1, 2, 3, 4, 5)], "status_id long, user_id long, created_ms long, source string")
    got = {r["status_id"]: (r["user_id"], r["label"], r["position"]) for r in resolve.training_statuses(acc, st).collect()}
    assert got == {2: (9, "bot", 0), 3: (8, "human", 1), 4: (7, "human", 1), 5: (9, "bot", 1)}
