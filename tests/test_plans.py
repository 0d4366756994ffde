"""Plan-shape regression tests for the properties the scale design relies
on (see PLANS.md)."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def executed_plan(spark, key):
    df = entry.queries()[key](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_combines_on_the_map_side_and_sorts_no_account(spark):
    plan = executed_plan(spark, "user_features")
    assert "Window" not in plan  # no account's history is sorted
    assert "partial_count" in plan and "partial_sum" in plan
    assert "LeftAnti" in plan  # gate


def test_latest_n_orders_no_account_as_a_whole(spark):
    """Posts are ordered within (account, range); what is ordered by account
    alone are counts of ranges."""
    plan = executed_plan(spark, "timeline_latest_5000").split("Initial Plan")[-1]
    ranks = [x for x in plan.splitlines() if "row_number()" in x and "Window" in x]
    assert ranks and all("_range" in x.split("windowspecdefinition(")[1].split(",")[1] for x in ranks)
    assert "partial_count" in plan


def test_tokenize_has_no_shuffle(spark):
    assert "Exchange" not in executed_plan(spark, "tokenize")


def test_bucketed_tables_are_not_shuffled(spark):
    """No exchange stands between a bucketed scan and its join or aggregate."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed_plan(spark, "bucketed_lookup").split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert plan.count("SelectedBucketsCount: 16 out of 16") >= 4 or "Bucketed: true" in plan


@pytest.mark.parametrize("key", ["feature_reuse", "incremental_refresh", "feature_preview"])
def test_posts_are_restricted_before_they_are_shuffled(spark, key):
    """The semi-join stands below every aggregate of posts."""
    plan = executed_plan(spark, key).split("Initial Plan")[-1]
    assert "LeftSemi" in plan
    lines = plan.splitlines()
    semi = [i for i, x in enumerate(lines) if "LeftSemi" in x]
    counts = [i for i, x in enumerate(lines) if "partial_count" in x or "partial_sum" in x]
    assert counts and max(semi) > min(counts)


def test_reuse_of_all_accounts_reads_on_no_post(spark):
    from botsift.operators import features as fx
    from botsift.operators import resolve
    from botsift.session import materialize
    from botsift.sources import fixtures as fix

    u, s = fix.users(spark, SF), fix.statuses(spark, SF)
    stored = materialize(fx.user_features(u, s), "t-stored")
    out = resolve.feature_reuse(u, s, stored)
    assert out.filter("origin = 'stored'").count() == u.count() == out.count()
    todo = u.join(stored.select(stored.id.alias("user_id")), "user_id", "left_anti")
    assert resolve.posts_of(s, todo).count() == 0


@pytest.mark.parametrize("key", ["user_features", "labelled_statuses", "dedupe_last_wins",
                                 "profile_store_lookup", "idf_tokens", "main_device"])
def test_no_python_or_cartesian(spark, key):
    plan = executed_plan(spark, key)
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, bad
