"""Mergeable feature state: any split of the posts into batches gives the
feature rows of all posts; a refresh reads the new posts only."""

import os

import pytest
from pyspark.sql import functions as F

from botsift import schemas
from botsift.operators import features as fx
from botsift.operators import state
from botsift.session import scratch_path
from botsift.sources import fixtures as fix
from tests.helpers import frames, post, user

DAY = 86_400_000
COLS = schemas.FEATURE_COLUMNS


def rows(df):
    return sorted(map(str, df.select(*COLS).collect()))


@pytest.fixture(scope="module")
def data(spark):
    users = [user(i, followers=i, protected=i == 7) for i in range(1, 10)]
    posts = [post(100 + k, 1 + k % 5, ms=None if k % 11 == 0 else DAY * (k % 6) + (k % 4) * 1000, source=["web", "app", "", None, "tv"][k % 5 if k % 3 else 0],
                  n_urls=k % 2, n_tags=k % 4, n_ment=k % 3) for k in range(120)]
    posts += [post(500, 7, ms=5), post(501, 8, ms=None, source=""), post(502, 9, ms=9, source="web")] + [
        post(600 + k, 3, ms=77, source="bot") for k in range(300)]
    return frames(spark, users, posts)


@pytest.mark.parametrize("bucket", ["exact", "day"])
@pytest.mark.parametrize("batches", [1, 3])
def test_batches_merge_to_the_features_of_all_posts(spark, data, batches, bucket):
    users, posts = data
    root = scratch_path(spark, "t-state")
    for i in range(batches):
        state.append(state.post_state(posts.filter(F.pmod(F.xxhash64("status_id"), F.lit(batches)) == i), bucket), root, i, parts=4)
    got = state.features_of(users, state.read(spark, root, parts=4))
    assert rows(got) == rows(fx.user_features(users, posts, bucket=bucket))


def test_replay_uncommitted_and_compaction(spark, data):
    users, posts = data
    root, want = scratch_path(spark, "t-state"), rows(fx.user_features(users, posts))
    part = lambda i: posts.filter(F.col("status_id") % 3 == i)
    state.append(state.post_state(part(0)), root, 1, parts=4)
    state.append(state.post_state(part(1)), root, 2, parts=4)
    state.append(state.post_state(part(1)), root, 2, parts=4)      # the same batch again
    state.compact(spark, root, parts=4)
    state.append(state.post_state(part(2)), root, 3, parts=4)
    state.append(state.post_state(posts), root, 4, parts=4)        # a job that did not commit
    os.remove(f"{root}/devices/version=4/_SUCCESS".removeprefix("file:"))
    assert state.versions(spark, root) == (2, [3])
    assert rows(state.features_of(users, state.read(spark, root, parts=4))) == want
    state.compact(spark, root, parts=4)
    assert state.versions(spark, root) == (3, [])
    assert rows(state.features_of(users, state.read(spark, root, parts=4))) == want


def test_refresh_reads_new_posts_and_touched_rows_only(spark, data):
    users, posts = data
    root = scratch_path(spark, "t-state")
    is_new = F.col("status_id").isin(101, 106, 111, 502)  # accounts 2 and 9
    state.append(state.post_state(posts.filter(~is_new)), root, 1, parts=8)
    stored = fx.user_features(users, posts.filter(~is_new)).filter("id <> 6")  # one account was not stored yet
    out = state.refresh(users, stored, posts.filter(is_new), root, 2, parts=8)
    assert rows(out) == rows(fx.user_features(users, posts))
    origin = {r["id"]: r["origin"] for r in out.collect()}
    assert {i for i, o in origin.items() if o == "refreshed"} == {2, 6, 9}
    # rows that go into the merge are those of the touched accounts
    touched = state.read(spark, root, users.filter("user_id IN (2, 9)"), parts=8)
    assert {r["user_id"] for r in touched.buckets.collect()} == {2, 9}
    plan = touched.devices._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and plan.index("HashAggregate") < plan.index("LeftSemi")  # filtered below the merge


def test_empty_log_and_empty_batch(spark, data):
    users, posts = data
    root = scratch_path(spark, "t-state")
    want = rows(fx.user_features(users, posts.limit(0)))
    assert rows(state.features_of(users, state.read(spark, root))) == want
    state.append(state.post_state(posts.limit(0)), root, 1, parts=2)
    assert rows(state.features_of(users, state.read(spark, root, parts=2))) == want


def test_float_precision(spark):
    sf = "/root/testdata/sf0.001"
    users, st = fix.users(spark, sf), fix.statuses(spark, sf)
    got = state.features_of(users, state.post_state(st), precision="float")
    assert sorted(map(str, got.collect())) == sorted(map(str, fx.user_features(users, st, precision="float").select(*got.columns).collect()))
