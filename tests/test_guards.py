"""Scale guards: no job starts while a plan is built, the gate keeps its
anti-join semantics, limits and settings that cannot hold raise."""

import pytest
from pyspark.sql import functions as F

from botsift import session
from botsift.operators import resolve, spam
from botsift.operators import timeline as tl
from botsift.sources import fixtures as fix
from tests.helpers import frames, post, user


def test_plans_are_built_without_a_job(spark, sf_small):
    u, s = fix.users(spark, sf_small), fix.statuses(spark, sf_small)
    posts = spark.createDataFrame([], "status_id long, label string, text string, urls array<struct<url:string,expanded_url:string>>")
    acc = spark.createDataFrame([], "line long, label string, user_id long, status_ids array<long>")
    threats = fix.threats(spark, sf_small)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        tl.timeline(s, u), tl.timeline(s, u, 50), tl.interarrivals(s), tl.statuses_by_user(s)
        resolve.resolve_users(acc.drop("line"), u), resolve.training_statuses(acc, s)
        spam.spam_urls(spam.status_urls(posts), threats), spam.labelled_statuses(posts, threats), spam.spam_counts(posts, threats)
        assert list(tracker.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_gate(spark):
    u, s = frames(spark, [user(1, protected=True), user(2), user(3, protected=None)],
                  [post(1, 1, 10), post(2, 2, 20), post(3, 3, 30), post(4, 4, 40)])
    # protected account 1 is dropped; NULL protection counts as visible
    assert sorted(r["status_id"] for r in tl.gate_protected(s, u).collect()) == [2, 3, 4]
    assert tl.gate_protected(s, u).filter(F.col("user_id") == 1).count() == 0


@pytest.mark.parametrize("n", [0, -1])
def test_limits_below_one_raise(spark, sf_small, n):
    with pytest.raises(ValueError, match="n must be"):
        tl.latest_n(fix.statuses(spark, sf_small), n)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    Context.master = "local-cluster[2,1,512]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
