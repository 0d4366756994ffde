"""user_features against an independent brute-force implementation of the
reference's per-account loop, on sf0.001 and on a skewed variant in which
one account owns a third of all posts."""

import math

import pytest
from pyspark.sql import functions as F

from botsift.operators import features as fx
from botsift.sources import fixtures as fix

N = 50


def brute(users, posts, n):
    """Per account, as the reference computes it (newest n posts, gate)."""
    by_user = {}
    for p in posts:
        by_user.setdefault(p["user_id"], []).append(p)
    out = {}
    for u in users:
        uid = u["user_id"]
        tl = [] if u["is_protected"] else sorted(
            by_user.get(uid, []),
            key=lambda p: (p["created_ms"] is None, -(p["created_ms"] or 0), -p["status_id"]))[:n]
        f = {
            "isProtected": 1.0 if u["is_protected"] else 0.0,
            "isVerified": 1.0 if u["is_verified"] else 0.0,
            "screenNameLength": len(u["screen_name"]),
            "followerRatio": (u["followers_count"] + 1.0) / (u["followers_count"] + 1.0 + u["friends_count"]),
        }
        if not tl:
            f.update(urlRatio=-1.0, hashtagRatio=-1.0, mentionRatio=-1.0, uniqueDevices=0,
                     mainDeviceCount=0, mainDevice="NA", tweetRate=-1.0, maxTweetRate=0, meanIA=-1.0)
            out[uid] = f
            continue
        k = len(tl)
        f["urlRatio"] = sum(1 for p in tl if p["n_urls"] > 0) / k
        f["hashtagRatio"] = sum(p["n_tags"] for p in tl) / k
        f["mentionRatio"] = sum(p["n_ment"] for p in tl) / k
        dev = {}
        for p in tl:
            if p["source"]:
                dev[p["source"]] = dev.get(p["source"], 0) + 1
        if dev:
            best = min(dev.items(), key=lambda kv: (-kv[1], kv[0]))
            f.update(uniqueDevices=len(dev), mainDevice=best[0], mainDeviceCount=best[1])
        else:
            f.update(uniqueDevices=0, mainDevice="NA", mainDeviceCount=-1)
        times = [p["created_ms"] for p in tl if p["created_ms"] is not None]
        buckets = {}
        for t in times:
            buckets[t] = buckets.get(t, 0) + 1
        f["tweetRate"] = len(times) / len(buckets) if buckets else -1.0
        f["maxTweetRate"] = max(buckets.values()) if buckets else 0
        gaps = [a - b for a, b in zip(times, times[1:])]
        f["meanIA"] = sum(gaps) / len(gaps) if gaps else -1.0
        out[uid] = f
    return out


def _posts(statuses):
    rows = statuses.select(
        "status_id", "user_id", "created_ms", "source",
        F.size("urls").alias("n_urls"), F.size("hashtags").alias("n_tags"),
        F.size("mentions").alias("n_ment")).collect()
    return [r.asDict() for r in rows]


@pytest.mark.parametrize("skewed", [False, True])
def test_user_features_brute_force(spark, sf_small, skewed):
    users = fix.users(spark, sf_small)
    st = fix.statuses(spark, sf_small)
    if skewed:  # one hot account owns every third post
        st = st.withColumn("user_id", F.when(F.col("status_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")))
    for n in (N, None):
        got = {r["id"]: r.asDict() for r in fx.user_features(users, st, n=n).collect()}
        want = brute([r.asDict() for r in users.collect()], _posts(st), n)
        assert set(got) == set(want)
        for uid, w in want.items():
            for col, v in w.items():
                g = got[uid][col]
                assert g == v or (isinstance(v, float) and math.isclose(g, v, rel_tol=0, abs_tol=0)), (uid, col, g, v)
