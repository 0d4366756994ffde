"""Behavioural features per account (the feature table).

Algebraic aggregates (count, sum, min, max) with map-side partial combine;
the two arg-max style features (main device, busiest time bucket) are
two-level aggregates whose first level is keyed by (account, device) /
(account, bucket), so a hot account spreads over many tasks.  All posts count
by default; with ``n`` the n newest of an account, for any n.

Sentinels follow the reference exactly (fixed values):
  no posts:            urlRatio, hashtagRatio, mentionRatio, tweetRate, meanIA = -1,
                       uniqueDevices = 0, mainDevice = 'NA', mainDeviceCount = 0,
                       maxTweetRate = 0
  posts, no device:    mainDevice = 'NA', mainDeviceCount = -1, uniqueDevices = 0
  posts, no timestamp: tweetRate = -1, maxTweetRate = 0, meanIA = -1
  fewer than 2 timestamps: meanIA = -1
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botsift.functions.columns import (
    day_bucket, flag, float32, follower_ratio, following_ratio, ratio, screen_name_length, size0,
)
from botsift.operators import timeline as tl

NO_DEVICE = "NA"
BUCKETS = ("exact", "day")


def _bucket(bucket: str) -> Column:
    if bucket == "exact":
        return F.col("created_ms")
    if bucket == "day":
        return day_bucket("created_ms")
    raise ValueError(f"bucket must be one of {BUCKETS}, got {bucket!r}")


COUNT_COLUMNS = ["user_id", "status_id", "created_ms", "source", "n_urls", "n_hashtags", "n_mentions"]


def post_counts(statuses: DataFrame) -> DataFrame:
    """Replace entity arrays by their sizes (no-op if already counted)."""
    if "n_urls" in statuses.columns:
        return statuses
    return statuses.withColumns({
        "n_urls": size0("urls"), "n_hashtags": size0("hashtags"), "n_mentions": size0("mentions"),
    }).drop("urls", "hashtags", "mentions")


def status_entity_counts(statuses: DataFrame) -> DataFrame:
    """Per post: entity counts and the has-URL predicate."""
    return statuses.select(
        "status_id", "user_id",
        size0("urls").alias("n_urls"),
        size0("hashtags").alias("n_hashtags"),
        size0("mentions").alias("n_mentions"),
        (size0("urls") > 0).alias("has_url"),
    )


def status_ratios(statuses: DataFrame) -> DataFrame:
    """Per account: post count and URL / hashtag / mention ratios."""
    return statuses.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_statuses"),
        F.sum(F.when(size0("urls") > 0, 1).otherwise(0)).alias("_n_url"),
        F.sum(size0("hashtags")).alias("_n_tags"),
        F.sum(size0("mentions")).alias("_n_ment"),
    ).select(
        "user_id", "n_statuses",
        ratio("_n_url", "n_statuses").alias("urlRatio"),
        ratio("_n_tags", "n_statuses").alias("hashtagRatio"),
        ratio("_n_ment", "n_statuses").alias("mentionRatio"),
    )


def device_counts(statuses: DataFrame) -> DataFrame:
    """Device histogram: posts per (account, non-blank source)."""
    return (
        statuses.filter(F.col("source").isNotNull() & (F.col("source") != F.lit("")))
        .groupBy("user_id", "source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def main_device(devices: DataFrame) -> DataFrame:
    """From a device histogram: distinct devices, the most used one and its
    count.  Ties go to the smallest source string (deterministic; the
    reference's order is hash-map order)."""
    return devices.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("uniqueDevices"),
        F.min_by("source", F.struct((-F.col("n")).alias("k"), F.col("source").alias("s")))
        .alias("mainDevice"),
        F.max("n").alias("mainDeviceCount"),
    )


def tweet_buckets(statuses: DataFrame, bucket: str = "exact") -> DataFrame:
    """Posts per (account, time bucket); posts without a time are skipped."""
    return (
        statuses.filter(F.col("created_ms").isNotNull())
        .groupBy("user_id", _bucket(bucket).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def tweet_rates(buckets: DataFrame) -> DataFrame:
    """Mean and max posts per bucket."""
    return buckets.groupBy("user_id").agg(
        ratio(F.sum("n"), F.count(F.lit(1))).alias("tweetRate"),
        F.max("n").alias("maxTweetRate"),
    )


def mean_interarrival(statuses: DataFrame) -> DataFrame:
    """Mean gap between consecutive posts.

    The gaps of a newest-first series telescope: their sum is newest - oldest,
    so the mean is (max - min) / (count - 1) -- one aggregate, no window.
    """
    g = statuses.groupBy("user_id").agg(
        F.count("created_ms").alias("_n"),
        F.min("created_ms").alias("_lo"),
        F.max("created_ms").alias("_hi"),
    )
    return g.select("user_id", _mean_ia("_n", "_lo", "_hi").alias("meanIA"))


def _mean_ia(n: str, lo: str, hi: str) -> Column:
    return (
        F.when(F.col(n) >= 2, ratio(F.col(hi) - F.col(lo), F.col(n) - 1))
        .otherwise(F.lit(-1.0))
    )


def bucket_counts(statuses: DataFrame, bucket: str = "exact") -> DataFrame:
    """The counts of every (account, time bucket).  Posts with no time land
    in bucket NULL: they count as posts but not as a bucket or a time."""
    return post_counts(statuses).groupBy("user_id", _bucket(bucket).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("n_urls") > 0, 1).otherwise(0)).alias("n_url"),
        F.sum("n_hashtags").alias("n_tags"),
        F.sum("n_mentions").alias("n_ment"),
        F.count("created_ms").alias("n_ms"),
        F.min("created_ms").alias("lo"),
        F.max("created_ms").alias("hi"),
    )


def timeline_summary(statuses: DataFrame, bucket: str = "exact") -> DataFrame:
    """Ratios, rates and inter-arrival of every account in one two-level
    aggregate: level 1 by (account, time bucket), level 2 by account."""
    return summarize(bucket_counts(statuses, bucket))


def summarize(buckets: DataFrame) -> DataFrame:
    """Level 2: one row per account from its ``bucket_counts``."""
    timed = F.col("bucket").isNotNull()
    lvl2 = buckets.groupBy("user_id").agg(
        F.sum("n").alias("n_statuses"),
        F.sum("n_url").alias("n_url"),
        F.sum("n_tags").alias("n_tags"),
        F.sum("n_ment").alias("n_ment"),
        F.sum("n_ms").alias("n_ms"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count(F.when(timed, 1)).alias("n_buckets"),
        F.sum(F.when(timed, F.col("n"))).alias("n_bucketed"),
        F.max(F.when(timed, F.col("n"))).alias("max_bucket"),
    )
    return lvl2.select(
        "user_id", "n_statuses",
        ratio("n_url", "n_statuses").alias("urlRatio"),
        ratio("n_tags", "n_statuses").alias("hashtagRatio"),
        ratio("n_ment", "n_statuses").alias("mentionRatio"),
        F.when(F.col("n_buckets") > 0, ratio("n_bucketed", "n_buckets")).alias("tweetRate"),
        F.col("max_bucket").alias("maxTweetRate"),
        _mean_ia("n_ms", "lo", "hi").alias("meanIA"),
        "n_ms", (F.col("hi") - F.col("lo")).alias("span_ms"),
    )


FOLLOW_RATIOS = ("code", "documented")


def profile_features(users: DataFrame, follow_ratio: str = "code") -> DataFrame:
    """Account-level features that need no posts.

    ``follow_ratio='code'`` (default, parity): (followers+1) /
    ((followers+1) + friends).  ``'documented'``: friends / followers, the
    meaning given in the reference's comment (NULL without followers).
    """
    if follow_ratio not in FOLLOW_RATIOS:
        raise ValueError(f"follow_ratio must be one of {FOLLOW_RATIOS}")
    ratio_col = (follower_ratio("followers_count", "friends_count") if follow_ratio == "code"
                 else following_ratio("friends_count", "followers_count"))
    return users.select(
        F.col("user_id").alias("id"),
        "label",
        flag("is_protected").alias("isProtected"),
        flag("is_verified").alias("isVerified"),
        screen_name_length("screen_name").alias("screenNameLength"),
        ratio_col.alias("followerRatio"),
    )


def apply_sentinels(profile: DataFrame, summary: DataFrame, devices: DataFrame, precision: str = "double") -> DataFrame:
    """Left-join post features to every account and fill the sentinels.

    ``summary`` carries the ratio/rate/time columns, ``devices`` the device
    columns.  ``precision='float'`` reproduces the
    reference's float32 arithmetic (see ``to_reference_precision``).
    """
    j = profile.join(summary.withColumnRenamed("user_id", "id"), "id", "left")
    j = j.join(devices.withColumnRenamed("user_id", "id"), "id", "left")
    has_posts = F.col("n_statuses").isNotNull()
    out = j.select(
        "id", "label", "isProtected", "isVerified",
        F.coalesce("meanIA", F.lit(-1.0)).alias("meanIA"),
        F.coalesce("tweetRate", F.lit(-1.0)).alias("tweetRate"),
        F.coalesce("maxTweetRate", F.lit(0)).cast("bigint").alias("maxTweetRate"),
        "screenNameLength", "followerRatio",
        F.coalesce("urlRatio", F.lit(-1.0)).alias("urlRatio"),
        F.coalesce("hashtagRatio", F.lit(-1.0)).alias("hashtagRatio"),
        F.coalesce("mentionRatio", F.lit(-1.0)).alias("mentionRatio"),
        F.coalesce("uniqueDevices", F.lit(0)).cast("bigint").alias("uniqueDevices"),
        F.when(~has_posts, F.lit(0))
        .when(F.col("mainDeviceCount").isNull(), F.lit(-1))
        .otherwise(F.col("mainDeviceCount")).cast("bigint").alias("mainDeviceCount"),
        F.coalesce("mainDevice", F.lit(NO_DEVICE)).alias("mainDevice"),
        "n_ms", "span_ms",
    )
    if precision == "float":
        return to_reference_precision(out)
    if precision != "double":
        raise ValueError("precision must be 'double' or 'float'")
    return out.drop("n_ms", "span_ms")


def to_reference_precision(features: DataFrame) -> DataFrame:
    """FLOAT / INT columns computed the way the reference's Java does.

    Ratios are integer quotients, so rounding the correctly rounded DOUBLE
    quotient to FLOAT equals a float32 division (double rounding is harmless
    for one division).  meanIA is different: the reference converts the
    long span to float *before* dividing, so it is recomputed from the span.
    Needs the helper columns n_ms and span_ms (dropped here).
    """
    f32 = {c: F.col(c).cast("float") for c in
           ("isProtected", "isVerified", "tweetRate", "followerRatio", "urlRatio",
            "hashtagRatio", "mentionRatio")}
    mean_ia = F.when(
        F.col("n_ms") >= 2,
        (float32("span_ms") / float32(F.col("n_ms") - 1)).cast("float"),
    ).otherwise(F.lit(-1.0).cast("float"))
    ints = {c: F.col(c).cast("int") for c in
            ("maxTweetRate", "screenNameLength", "uniqueDevices", "mainDeviceCount")}
    cols = []
    for c in features.columns:
        if c in ("n_ms", "span_ms"):
            continue
        if c == "meanIA":
            cols.append(mean_ia.alias(c))
        elif c in f32:
            cols.append(f32[c].alias(c))
        elif c in ints:
            cols.append(ints[c].alias(c))
        else:
            cols.append(F.col(c))
    return features.select(*cols)


def user_features(
    users: DataFrame,
    statuses: DataFrame,
    n: int | None = None,
    bucket: str = "exact",
    gate: bool = True,
    precision: str = "double",
    follow_ratio: str = "code",
) -> DataFrame:
    """The full feature row for every account in ``users``.

    Every post counts, and the features come from partial (map-side
    combined) two-level aggregates, which tolerate hot accounts.  With ``n``
    set only the n newest posts of an account count (``latest_n``).
    """
    # entity arrays are reduced to counts before any shuffle: the features
    # only need their sizes, and the exchange then carries 7 narrow columns
    posts = post_counts(statuses).select(*COUNT_COLUMNS)
    posts = tl.gate_protected(posts, users) if gate else posts
    if n is not None:
        posts = tl.latest_n(posts, n, rank_col=None)
    summary = timeline_summary(posts, bucket)
    devices = main_device(device_counts(posts))
    return apply_sentinels(profile_features(users, follow_ratio), summary, devices, precision=precision)


def main_device_with_sentinels(users: DataFrame, statuses: DataFrame) -> DataFrame:
    """uniqueDevices / mainDevice / mainDeviceCount for every account, with
    the 'no posts' and 'no device' sentinels kept apart.

    One histogram over (account, source) -- blank sources included, so it
    also yields the post count -- then one aggregate per account.
    """
    hist = statuses.groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("n"))
    device = F.col("source").isNotNull() & (F.col("source") != F.lit(""))
    per_user = hist.groupBy("user_id").agg(
        F.sum("n").alias("n_statuses"),
        F.count(F.when(device, 1)).alias("uniqueDevices"),
        F.min_by(F.when(device, F.col("source")),
                 F.when(device, F.struct((-F.col("n")).alias("k"), F.col("source").alias("s"))))
        .alias("mainDevice"),
        F.max(F.when(device, F.col("n"))).alias("mainDeviceCount"),
    )
    j = users.select("user_id").join(per_user, "user_id", "left")
    return j.select(
        F.col("user_id").alias("id"),
        F.coalesce("uniqueDevices", F.lit(0)).cast("bigint").alias("uniqueDevices"),
        F.coalesce("mainDevice", F.lit(NO_DEVICE)).alias("mainDevice"),
        F.when(F.col("n_statuses").isNull(), F.lit(0))
        .when(F.col("mainDeviceCount").isNull(), F.lit(-1))
        .otherwise(F.col("mainDeviceCount")).cast("bigint").alias("mainDeviceCount"),
    )
