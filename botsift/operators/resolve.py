"""Entity resolution: labelled ids -> accounts, posts -> owners, labels.

Every reference driver-side HashMap probe becomes an equi-join; Spark (with
AQE) picks broadcast or sort-merge from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.operators import dedupe
from botsift.operators import features as fx
from botsift.sources.labelled import LISTED_USED, dedupe_accounts, first_listed


def resolve_users(accounts: DataFrame, users: DataFrame) -> DataFrame:
    """Labelled ids that resolve to an account (unresolved ids drop).

    ``accounts`` has one row per id (see ``dedupe_accounts``).  The labelled
    set is usually tiny next to the account table; the planner broadcasts it
    by its runtime size, else both sides shuffle on the id.
    """
    return users.drop("label").join(accounts.select("user_id", "label"), "user_id", "inner")


def current_labels(label_events: DataFrame) -> DataFrame:
    """Latest label per account from an ordered event log (seq, user_id, label)."""
    return dedupe.last_wins(label_events, "user_id", "seq")


def attach_label(users: DataFrame, labels: DataFrame) -> DataFrame:
    """Accounts with their current label (accounts without one drop)."""
    return users.drop("label").join(labels.select("user_id", "label"), "user_id", "inner")


def effective_labels(users: DataFrame, overrides: DataFrame) -> DataFrame:
    """A stored (override) label beats the file label."""
    o = overrides.select("user_id", F.col("label").alias("_override"))
    j = users.select("user_id", F.col("label").alias("_file")).join(o, "user_id", "left")
    return j.select(
        "user_id",
        F.coalesce("_override", "_file").alias("label"),
        F.when(F.col("_override").isNotNull(), F.lit("override")).otherwise(F.lit("file")).alias("label_source"),
    )


def training_statuses(accounts: DataFrame, statuses: DataFrame, n: int = LISTED_USED) -> DataFrame:
    """The first n listed posts of each labelled account, resolved to posts.

    At most n ids per account are exploded; posts that do not exist drop in
    the inner join.  As in the reference's maps, the last line
    of an account counts, and a post that several accounts list belongs to
    the one that lists it last.  ``accounts`` carries ``line``, the file order.
    """
    listed = first_listed(dedupe_accounts(accounts, keep_line=True), n).select(
        "user_id", "label", "line", F.posexplode("status_ids").alias("position", "status_id")
    ).filter(F.col("status_id").isNotNull())
    listed = dedupe.last_wins(listed.withColumn("_put", F.struct("line", "position")), "status_id", "_put")
    s = statuses.select("status_id", F.col("user_id").alias("author_id"), "created_ms", "source")
    return s.join(listed.drop("_put", "line"), "status_id", "inner")


def posts_of(statuses: DataFrame, accounts: DataFrame) -> DataFrame:
    """Only the posts of these accounts, before anything is done with them."""
    return statuses.join(accounts.select("user_id"), "user_id", "left_semi")


def feature_reuse(users: DataFrame, statuses: DataFrame, stored: DataFrame, n: int | None = None) -> DataFrame:
    """Features for every account: stored rows are reused, the rest computed.

    ``stored`` is a feature table (column ``id``).  Only accounts without a
    stored row, and only their posts, go through extraction.
    """
    want = users.select(F.col("user_id").alias("id"))
    reuse = stored.join(want, "id", "left_semi").withColumn("origin", F.lit("stored"))
    todo = users.join(stored.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    fresh = fx.user_features(todo, posts_of(statuses, todo), n=n).withColumn("origin", F.lit("computed"))
    return reuse.unionByName(fresh)


def refresh_features(users: DataFrame, statuses: DataFrame, stored: DataFrame, new_posts: DataFrame,
                     n: int | None = None) -> DataFrame:
    """Incremental feature update after new posts arrive.

    Feature rows do not merge, so accounts with new posts are recomputed from
    all their posts (old and new); every other account keeps its stored row
    and none of its posts is read further than the join.  ``statuses`` must already include ``new_posts``.
    Adds ``origin`` in {stored, refreshed}.
    """
    changed = new_posts.select("user_id").distinct()
    keep = stored.join(changed.select(F.col("user_id").alias("id")), "id", "left_anti")
    todo = users.join(changed, "user_id", "left_semi")
    fresh = fx.user_features(todo, posts_of(statuses, todo), n=n)
    return keep.withColumn("origin", F.lit("stored")).unionByName(fresh.withColumn("origin", F.lit("refreshed")))
