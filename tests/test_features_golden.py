"""Golden rows (FIXTURES.md section 3) for the feature operators, on both
the bounded-timeline (fused) path and the unbounded aggregate path."""

import pytest

from botsift.operators import features as fx
from botsift.operators import timeline as tl
from tests.helpers import frames, post, user

PATHS = [250, None]


def feats(spark, users, posts, n):
    u, s = frames(spark, users, posts)
    return {r["id"]: r.asDict() for r in fx.user_features(u, s, n=n).collect()}


@pytest.mark.parametrize("n", PATHS)
def test_follower_ratio(spark, n):
    f = feats(spark, [user(1, 0, 0), user(2, 9, 30)], [], n)
    assert f[1]["followerRatio"] == 1.0  # G-a
    assert f[2]["followerRatio"] == 0.25  # G-b


@pytest.mark.parametrize("n", PATHS)
def test_no_statuses_sentinels(spark, n):
    r = feats(spark, [user(1)], [], n)[1]  # G-c
    assert (r["urlRatio"], r["hashtagRatio"], r["mentionRatio"]) == (-1.0, -1.0, -1.0)
    assert (r["uniqueDevices"], r["mainDevice"], r["mainDeviceCount"]) == (0, "NA", 0)
    assert (r["tweetRate"], r["maxTweetRate"], r["meanIA"]) == (-1.0, 0, -1.0)


@pytest.mark.parametrize("n", PATHS)
def test_single_status(spark, n):
    r = feats(spark, [user(1)], [post(1, 1, 5000, "web")], n)[1]  # G-d
    assert (r["tweetRate"], r["maxTweetRate"], r["meanIA"]) == (1.0, 1, -1.0)
    assert (r["mainDevice"], r["mainDeviceCount"], r["uniqueDevices"]) == ("web", 1, 1)


@pytest.mark.parametrize("n", PATHS)
def test_statuses_without_device(spark, n):
    r = feats(spark, [user(1)], [post(1, 1, 10, None), post(2, 1, 20, "")], n)[1]  # G-e
    assert (r["mainDevice"], r["mainDeviceCount"], r["uniqueDevices"]) == ("NA", -1, 0)


@pytest.mark.parametrize("n", PATHS)
def test_mean_interarrival(spark, n):
    r = feats(spark, [user(1)], [post(1, 1, 10000), post(2, 1, 7000), post(3, 1, 1000)], n)[1]
    assert r["meanIA"] == 4500.0  # G-f
    # G-g: unsorted input; the reference would give -4500, we order explicitly (V4)
    r = feats(spark, [user(1)], [post(3, 1, 1000), post(2, 1, 7000), post(1, 1, 10000)], n)[1]
    assert r["meanIA"] == 4500.0


def test_interarrival_gaps(spark):
    u, s = frames(spark, [user(1)], [post(1, 1, 10000), post(2, 1, 7000), post(3, 1, 1000)])
    gaps = {r["status_id"]: r["gap_ms"] for r in tl.interarrivals(tl.timeline(s, u)).collect()}
    assert gaps == {1: 3000, 2: 6000}  # n - 1 gaps, as the reference's list


@pytest.mark.parametrize("n", PATHS)
def test_repeated_millisecond(spark, n):
    r = feats(spark, [user(1)], [post(1, 1, 5000), post(2, 1, 5000), post(3, 1, 2000)], n)[1]  # G-h
    assert (r["tweetRate"], r["maxTweetRate"], r["meanIA"]) == (1.5, 2, 1500.0)


@pytest.mark.parametrize("n", PATHS)
def test_all_timestamps_null(spark, n):
    r = feats(spark, [user(1)], [post(1, 1, None), post(2, 1, None)], n)[1]  # G-i (V3)
    assert (r["tweetRate"], r["maxTweetRate"], r["meanIA"]) == (-1.0, 0, -1.0)
    assert r["urlRatio"] == 0.0


@pytest.mark.parametrize("n", PATHS)
def test_some_timestamps_null(spark, n):
    r = feats(spark, [user(1)], [post(1, 1, 9000, n_tags=3), post(2, 1, None), post(3, 1, 3000)], n)[1]  # G-j
    assert r["hashtagRatio"] == 1.0  # divides by 3 posts
    assert (r["meanIA"], r["tweetRate"]) == (6000.0, 1.0)


@pytest.mark.parametrize("n", PATHS)
def test_ratios(spark, n):
    ps = [post(1, 1, 1, n_urls=2), post(2, 1, 2), post(3, 1, 3, n_urls=1), post(4, 1, 4)]
    assert feats(spark, [user(1)], ps, n)[1]["urlRatio"] == 0.5  # G-k
    ps = [post(1, 1, 1, n_tags=3), post(2, 1, 2)]
    assert feats(spark, [user(1)], ps, n)[1]["hashtagRatio"] == 1.5  # G-l


@pytest.mark.parametrize("n", PATHS)
def test_main_device_tie(spark, n):
    ps = [post(i + 1, 1, 100 * i, src) for i, src in enumerate(["web", "ios", "ios", "web", None])]
    r = feats(spark, [user(1)], ps, n)[1]  # G-m (V2: tie -> smallest source)
    assert (r["uniqueDevices"], r["mainDeviceCount"], r["mainDevice"]) == (2, 2, "ios")


@pytest.mark.parametrize("n", PATHS)
def test_protected_gate(spark, n):
    r = feats(spark, [user(1, protected=True)], [post(1, 1, 10), post(2, 1, 20)], n)[1]  # G-n
    assert r["isProtected"] == 1.0
    assert (r["urlRatio"], r["mainDevice"], r["mainDeviceCount"], r["tweetRate"]) == (-1.0, "NA", 0, -1.0)


def test_latest_n_bounds_timeline(spark):
    ps = [post(i, 1, i * 10) for i in range(1, 31)]
    r = feats(spark, [user(1)], ps, 5)[1]
    # newest 5 posts: ms 300..260, gaps 10 each
    assert r["meanIA"] == 10.0
    u, s = frames(spark, [user(1)], ps)
    ids = sorted(r["status_id"] for r in tl.timeline(s, u, 5).collect())
    assert ids == [26, 27, 28, 29, 30]


def test_daily_bucket(spark):
    day = 86_400_000
    ps = [post(1, 1, 10), post(2, 1, 20), post(3, 1, day + 5)]
    r = feats_b(spark, ps)
    assert (r["tweetRate"], r["maxTweetRate"]) == (1.5, 2)


def feats_b(spark, ps):
    u, s = frames(spark, [user(1)], ps)
    return fx.user_features(u, s, n=250, bucket="day").collect()[0].asDict()


def test_empty_input_gives_empty_output(spark):
    u, s = frames(spark, [], [])
    assert fx.user_features(u, s).count() == 0  # V19


def test_reference_float_precision(spark):
    """precision='float' reproduces Java float32 arithmetic (V12)."""
    import numpy as np

    big = 1_700_000_000_123
    ps = [post(1, 1, big, n_tags=1), post(2, 1, big + 7_777_777, n_urls=1),
          post(3, 1, big + 8_888_888), post(4, 1, big + 123_456_796)]
    u, s = frames(spark, [user(1, followers=6, friends=7)], ps)
    r = fx.user_features(u, s, precision="float").collect()[0].asDict()
    span = np.float32(123_456_796)  # long -> float first, as in Java (rounds above 2**24)
    assert r["meanIA"] == float(np.float32(span / np.float32(3)))
    assert r["meanIA"] != float(np.float32(123_456_796 / 3))  # differs from the DOUBLE path
    assert r["followerRatio"] == float(np.float32(np.float32(7) / np.float32(14)))
    assert r["urlRatio"] == float(np.float32(np.float32(1) / np.float32(4)))
    assert r["hashtagRatio"] == float(np.float32(1) / np.float32(4))
    types = dict(fx.user_features(u, s, precision="float").dtypes)
    assert types["meanIA"] == "float" and types["maxTweetRate"] == "int"


def test_documented_follow_ratio(spark):
    u, s = frames(spark, [user(1, followers=10, friends=30), user(2, followers=0, friends=5)], [])
    got = {r["id"]: r["followerRatio"] for r in fx.user_features(u, s, follow_ratio="documented").collect()}
    assert got == {1: 3.0, 2: None}
