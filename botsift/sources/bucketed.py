"""Bucketed tables, so that lookups by account shuffle no large side.

Tables that are joined on the same key again and again (profile store,
accounts, posts) are written once in buckets of that key, sorted within.
Joins between them, and aggregates by the key, then read bucket by bucket:
no exchange stands above such a scan, however large the table is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.session import scratch_path
from botsift.sources.profile_store import FOUND, MISSING, UNSEEN

BUCKETS = 16  # of the same number in all tables that are joined; a large store wants more


def write_bucketed(df: DataFrame, name: str, key: str = "user_id", buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write ``df`` as a bucketed table (one file per bucket) under the shared
    folder, or ``path``, and return it."""
    spark = df.sparkSession
    table = f"botsift_{name}_{uuid.uuid4().hex}"
    w = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path or scratch_path(spark, name))
    w.mode("overwrite").format("parquet").saveAsTable(table)
    return spark.table(table)


def lookup(requests: DataFrame, store: DataFrame, users: DataFrame, posts: DataFrame) -> DataFrame:
    """Every requested id once: state in the store (found, missing, unseen),
    whether it is an account, whether it has to be fetched (an account that
    the store lacks), and its posts.  All four tables are bucketed alike on
    user_id; NULL ids are not requests."""
    want = requests.filter("user_id IS NOT NULL").select("user_id").distinct()
    s = store.select("user_id", "state")
    accounts = users.select("user_id", F.lit(True).alias("is_account"))
    fetch = want.join(s, "user_id", "left_anti").join(accounts, "user_id", "left_semi").withColumn("to_fetch", F.lit(True))
    n = posts.join(want, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_posts"))
    x = want.join(s, "user_id", "left").join(accounts, "user_id", "left").join(fetch, "user_id", "left").join(n, "user_id", "left")
    return x.select("user_id", F.coalesce("state", F.lit(UNSEEN)).alias("state"), F.coalesce("is_account", F.lit(False)).alias("is_account"),
                    F.coalesce("to_fetch", F.lit(False)).alias("to_fetch"), F.coalesce("n_posts", F.lit(0)).alias("n_posts"))


__all__ = ["BUCKETS", "FOUND", "MISSING", "UNSEEN", "lookup", "write_bucketed"]
