"""Per-account timelines: the protected-account gate, latest-N, gaps.

By default the timeline of an account is all its posts; N newest posts are
an option (``latest_n``).  What needs per-account order over all posts is
split by account *and* time range, so an account with a third of all posts
is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from botsift.functions.columns import DAY_MS

RANGE_MS = DAY_MS // 24  # posts of one account and hour are ordered by one task
RANGE_IDS = 1 << 16      # and of those without a time, ids of such a range


def _newest_first() -> list[Column]:
    return [F.col("created_ms").desc_nulls_last(), F.col("status_id").desc()]


def gate_protected(statuses: DataFrame, users: DataFrame) -> DataFrame:
    """Drop the posts of protected accounts (their timelines are not visible).

    An anti-join against the protected ids, a small share of all accounts;
    the planner (AQE, from the ids' runtime size) broadcasts them if it can.
    """
    # a plain boolean filter (NULL does not pass) so the predicate can reach the scan
    protected = users.filter(F.col("is_protected")).select("user_id")
    return statuses.join(protected, "user_id", "left_anti")


def latest_n(statuses: DataFrame, n: int, rank_col: str | None = "rank", range_ms: int = RANGE_MS,
             range_ids: int = RANGE_IDS) -> DataFrame:
    """The n newest posts per account, for any n (ties on time broken by
    larger id; posts without a time come last).

    A distributed selection: posts are counted per (account, time range), the
    counts of newer ranges tell how many posts come before a range, and a
    range with n or more before it is left out by the join.  Only within a
    range are posts ordered, so no task holds an account's history, and what
    is ordered per account are its ranges' counts.
    """
    if n < 1:
        raise ValueError("n must be 1 or more (None, where allowed, takes all posts)")
    # one key for both kinds of range: timed ranges are newer than all ranges of ids
    timed = F.col("created_ms").isNotNull()
    key = F.struct(timed.alias("t"), F.when(timed, F.floor(F.col("created_ms") / range_ms)).otherwise(
        F.floor(F.col("status_id") / range_ids)).alias("r"))
    s = statuses.withColumn("_range", key)
    counts = s.groupBy("user_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    newer = W.partitionBy("user_id").orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranges = counts.select("user_id", "_range", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before"))
    ranges = ranges.filter(F.col("_before") < n).withColumnRenamed("user_id", "_user")
    # accounts without an id are one account, as in a grouping
    x = s.join(ranges.withColumnRenamed("_range", "_r"), s["user_id"].eqNullSafe(F.col("_user")) & (F.col("_range") == F.col("_r")))
    inside = F.row_number().over(W.partitionBy("user_id", "_range").orderBy(*_newest_first()))
    out = x.withColumn("_rank", F.col("_before") + inside).filter(F.col("_rank") <= n)
    cols = statuses.columns if not rank_col else [*statuses.columns, F.col("_rank").cast("int").alias(rank_col)]
    return out.select(*cols)


def timeline(statuses: DataFrame, users: DataFrame, n: int | None = None) -> DataFrame:
    """The visible posts: all of them, or the n newest per account.

    The gate is a per-account filter, so it commutes with the per-account
    limit and stands below it: closed posts are not counted at all.
    """
    seen = gate_protected(statuses, users)
    return seen if n is None else latest_n(seen, n)


def interarrivals(timeline_df: DataFrame, range_ms: int = RANGE_MS) -> DataFrame:
    """Gap in ms between each post and the next older one (newest first).

    Posts without a timestamp are not part of the time series.  Like the
    reference's list, an account with n timed posts has n - 1 gaps: the
    oldest post has no successor and yields no row.

    Posts are ordered within (account, time range); the oldest post of a
    range takes its successor from the table of the ranges' newest times,
    which has one row per account and range with posts.
    """
    t = timeline_df.filter(F.col("created_ms").isNotNull()).select(
        "user_id", "status_id", "created_ms", F.floor(F.col("created_ms") / range_ms).alias("_range"))
    newest = t.groupBy("user_id", "_range").agg(F.max("created_ms").alias("_newest"))
    before = newest.select("user_id", "_range", F.lag("_newest").over(
        W.partitionBy("user_id").orderBy("_range")).alias("_before"))
    w = W.partitionBy("user_id", "_range").orderBy(*_newest_first())
    g = t.withColumn("_next", F.lead("created_ms").over(w)).join(before, ["user_id", "_range"])
    g = g.withColumn("gap_ms", F.col("created_ms") - F.coalesce("_next", "_before"))
    return g.select("user_id", "status_id", "created_ms", "gap_ms").filter(F.col("gap_ms").isNotNull())


def statuses_by_user(timeline_df: DataFrame, fields: list[str | Column] | None = None,
                     chunk_ms: int = DAY_MS) -> DataFrame:
    """Nested view: (user_id, chunk, statuses), the posts of one account and
    time chunk (a day by default; NULL for posts without a time), newest
    first.  All posts are there, and no row holds more than a chunk's."""
    fields = fields or ["status_id", "source"]
    st = F.struct(F.col("created_ms").alias("created_ms"), F.col("status_id").alias("sid"),
                  *[F.col(f) if isinstance(f, str) else f for f in fields])
    chunk = F.floor(F.col("created_ms") / chunk_ms).alias("chunk")
    return timeline_df.groupBy("user_id", chunk).agg(
        F.reverse(F.sort_array(F.collect_list(st))).alias("statuses")
    )
