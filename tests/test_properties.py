"""Invariants of the feature table and the ingest operators on real fixture
"""

import pytest
from pyspark.sql import functions as F

from botsift.operators import features as fx
from botsift.operators import timeline as tl
from botsift.sources import fixtures as fix
from botsift.sources import profile_store as ps


def test_feature_invariants(spark, sf_small):
    users, st = fix.users(spark, sf_small), fix.statuses(spark, sf_small)
    f = fx.user_features(users, st)
    assert f.count() == users.count()
    bad = f.filter(
        ~((F.col("urlRatio") == -1) | F.col("urlRatio").between(0, 1))
        | ~((F.col("followerRatio") > 0) & (F.col("followerRatio") <= 1))
        | ((F.col("uniqueDevices") == 0) != (F.col("mainDevice") == "NA"))
    )
    assert bad.count() == 0
    counts = st.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    over = f.join(counts, "id").filter(F.col("mainDeviceCount") > F.col("n"))
    assert over.count() == 0


def test_a_long_timeline_is_all_posts(spark, sf_small):
    users, st = fix.users(spark, sf_small), fix.statuses(spark, sf_small)
    a = fx.user_features(users, st, n=10**6)
    b = fx.user_features(users, st, n=None)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("n", [1, 7, 333, 5000, 10**6])
def test_latest_n_of_a_hot_account(spark, sf_small, n):
    """One account with a third of all posts, ties in time, posts without a
    time; ranges of any size give the ranks of one sort."""
    from pyspark.sql import Window as W

    st = fix.statuses(spark, sf_small).select("status_id", "user_id", "created_ms").withColumn(
        "user_id", F.when(F.col("status_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))).withColumn(
        "created_ms", F.when(F.col("status_id") % 11 != 0, F.col("created_ms") - F.col("created_ms") % 600_000))
    st = st.unionByName(st.limit(40).withColumn("user_id", F.lit(None).cast("bigint")))
    w = W.partitionBy("user_id").orderBy(F.col("created_ms").desc_nulls_last(), F.col("status_id").desc())
    want = st.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    for ms, ids in ((1000, 3), (tl.RANGE_MS, tl.RANGE_IDS), (10**15, 10**9)):
        got = tl.latest_n(st, n, range_ms=ms, range_ids=ids)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_mean_of_gaps_equals_mean_interarrival(spark, sf_small):
    users, st = fix.users(spark, sf_small), fix.statuses(spark, sf_small)
    t = tl.timeline(st, users)
    g = tl.interarrivals(t).groupBy("user_id").agg(F.avg("gap_ms").alias("g"))
    m = fx.mean_interarrival(t)
    diff = g.join(m, "user_id").filter(F.abs(F.col("g") - F.col("meanIA")) > 1e-6)
    assert diff.count() == 0


def test_missing_and_known_partition_requests(spark, sf_small):
    users = fix.users(spark, sf_small)
    req = fix.lookup_requests(spark, sf_small)
    store = ps.resolve(req, users)
    missing = ps.missing(req, users).select("user_id")
    known = ps.known(req, store).select("user_id")
    assert missing.intersect(known).count() == 0
    assert missing.union(known).distinct().count() == req.select("user_id").distinct().count()


def test_interarrivals_do_not_depend_on_the_ranges(spark, sf_small):
    from pyspark.sql import Window as W

    st = fix.statuses(spark, sf_small).withColumn(  # one account with a third of all posts, some without a time
        "user_id", F.when(F.col("status_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))).withColumn(
        "created_ms", F.when(F.col("status_id") % 11 != 0, F.col("created_ms") - F.col("created_ms") % 600_000))
    w = W.partitionBy("user_id").orderBy(F.col("created_ms").desc(), F.col("status_id").desc())
    want = st.filter("created_ms IS NOT NULL").select("user_id", "status_id", "created_ms", (
        F.col("created_ms") - F.lead("created_ms").over(w)).alias("gap_ms")).filter("gap_ms IS NOT NULL")
    for ms in (1000, tl.RANGE_MS, 10**15):
        got = tl.interarrivals(st, ms)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_statuses_by_user_holds_every_post(spark, sf_small):
    st = fix.statuses(spark, sf_small)
    g = tl.statuses_by_user(st)
    assert g.select(F.explode("statuses")).count() == st.count()
    assert g.groupBy("user_id", "chunk").count().filter("count > 1").count() == 0
