"""Mergeable feature state: what the feature row of an account is made of, in
a form that new posts add to.

Feature rows do not merge (a mean of means is no mean), their ingredients do:

* ``buckets``: per (account, time bucket) the posts, links, tags, mentions and
  times, first and last; untimed posts are in bucket NULL;
* ``devices``: posts per (account, source).

All are sums, minima and maxima, so states of disjoint batches of posts merge
by one aggregate per table, in any order and grouping.  On disk a state is a
log: every batch appends its own rows as ``version=<v>``, dealt into ``part``
directories by account.  Reading a state aggregates the versions; reading it
for some accounts opens only their parts.  ``compact`` folds the log into one
version.  A version is written whole or, if a job is repeated, written anew,
so no batch counts twice; versions that lack ``_SUCCESS`` in one of the tables
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift import schemas
from botsift.operators import features as fx
from botsift.operators.timeline import gate_protected

PARTS = 16  # directories that a version's accounts are dealt into; a large store wants more

TABLES = {
    "buckets": ("user_id bigint, bucket bigint, n bigint, n_url bigint, n_tags bigint, n_ment bigint, n_ms bigint, lo bigint, hi bigint",
                ["user_id", "bucket"]),
    "devices": ("user_id bigint, source string, n bigint", ["user_id", "source"]),
}
_MERGED_BY = {"lo": F.min, "hi": F.max}  # every other measure is a sum


@dataclass
class FeatureState:
    buckets: DataFrame
    devices: DataFrame


def post_state(statuses: DataFrame, bucket: str = "exact") -> FeatureState:
    """The state of a batch of posts, of which each counts once.  Posts of
    protected accounts are in it too: ``features_of`` leaves them out, as
    whether an account is protected may change."""
    posts = fx.post_counts(statuses)
    buckets = fx.bucket_counts(posts, bucket).withColumn("bucket", F.col("bucket").cast("bigint"))
    return FeatureState(buckets, fx.device_counts(posts))


def merge(table: str, rows: DataFrame) -> DataFrame:
    """Rows of one state table, of any batches, as one row per key."""
    schema, keys = TABLES[table]
    measures = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in keys]
    return rows.groupBy(*keys).agg(*[_MERGED_BY.get(c, F.sum)(c).alias(c) for c in measures])


def features_of(users: DataFrame, state: FeatureState, precision: str = "double") -> DataFrame:
    """The feature rows of ``users`` from a merged state: those that
    ``user_features`` computes from all their posts."""
    summary = fx.summarize(gate_protected(state.buckets, users))
    devices = fx.main_device(gate_protected(state.devices, users))
    return fx.apply_sentinels(fx.profile_features(users), summary, devices, precision=precision)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")


def _write(rows: DataFrame, path: str, parts: int) -> None:
    # few files per part, but an account with most of the rows is split over tasks
    rows.withColumn("part", _part(parts)).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(path)


def append(state: FeatureState, root: str, version: int, parts: int = PARTS) -> None:
    """Write a batch's state as one version of the log under ``root``."""
    for table in TABLES:
        _write(getattr(state, table), f"{root}/{table}/version={version}", parts)


def versions(spark: SparkSession, root: str) -> tuple[int | None, list[int]]:
    """The last base (None without one) and the committed versions after it;
    either counts only if all tables have it whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(table: str) -> set[tuple[str, int]]:
        if not fs.exists(path(f"{root}/{table}")):
            return set()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{root}/{table}"))]
        return {(n.split("=")[0], int(n.split("=")[1])) for n in names
                if "=" in n and fs.exists(path(f"{root}/{table}/{n}/_SUCCESS"))}

    held = set.intersection(*[committed(t) for t in TABLES])
    base = max((v for kind, v in held if kind == "base"), default=None)
    return base, sorted(v for kind, v in held if kind == "version" and (base is None or v > base))


def read(spark: SparkSession, root: str, accounts: DataFrame | None = None, parts: int = PARTS) -> FeatureState:
    """The merged state, of all accounts or of those in ``accounts``
    (user_id).  Only their parts' files and, of these, only their rows go
    into the aggregate.  An empty log is an empty state."""
    out = {}
    base, deltas = versions(spark, root)
    held = ([] if base is None else [f"base={base}"]) + [f"version={v}" for v in deltas]
    for table, (schema, _) in TABLES.items():
        rows = spark.createDataFrame([], f"{schema}, part int")
        for name in held:
            rows = rows.unionByName(spark.read.schema(f"{schema}, part int").parquet(f"{root}/{table}/{name}"))
        if accounts is not None:
            want = accounts.select("user_id").distinct().withColumn("part", _part(parts))
            rows = rows.join(want, ["part", "user_id"], "left_semi")
        out[table] = merge(table, rows.drop("part"))
    return FeatureState(**out)


def compact(spark: SparkSession, root: str, parts: int = PARTS) -> None:
    """Fold all committed versions into one base; nothing is deleted, but
    later reads take the base and the versions after it."""
    _, deltas = versions(spark, root)
    if deltas:
        whole = read(spark, root, parts=parts)
        for table in TABLES:
            _write(getattr(whole, table), f"{root}/{table}/base={deltas[-1]}", parts)


def refresh(users: DataFrame, stored: DataFrame, new_posts: DataFrame, root: str, version: int, parts: int = PARTS) -> DataFrame:
    """Incremental feature update: append the new posts' state as
    ``version``, derive the rows of the accounts that have new posts from
    their state, and keep every other account's stored row.

    No older post is read: the work is that of the new posts and of the state
    rows of the accounts they belong to.  Accounts of ``users`` without a
    stored row and without posts get their sentinel row.  Adds ``origin``
    (stored, refreshed).
    """
    spark = users.sparkSession
    append(post_state(new_posts), root, version, parts)
    changed = new_posts.select("user_id").distinct()
    known = stored.select(F.col("id").alias("user_id"))
    todo = users.join(changed, "user_id", "left_semi").unionByName(
        users.join(known, "user_id", "left_anti").join(changed, "user_id", "left_anti"))
    fresh = features_of(todo, read(spark, root, todo, parts))
    keep = stored.join(users.select(F.col("user_id").alias("id")), "id", "left_semi").join(
        changed.select(F.col("user_id").alias("id")), "id", "left_anti")
    cols = schemas.FEATURE_COLUMNS
    return keep.select(*cols).withColumn("origin", F.lit("stored")).unionByName(
        fresh.select(*cols).withColumn("origin", F.lit("refreshed")))
