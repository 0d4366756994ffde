"""Status JSON-lines source: one post object per line, public v1.1 layout.

Read with an explicit schema in PERMISSIVE mode: a corrupt line becomes a
row of NULLs and is dropped with the posts that carry no user, so one bad
line never fails the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift import schemas
from botsift.functions.columns import parse_api_time, size0, api_time_string


def to_status_json(statuses: DataFrame, users: DataFrame) -> DataFrame:
    """Render posts (with their author embedded) as JSON text lines.

    ``statuses`` needs status_id, user_id, created_at, source, text, urls,
    hashtags, mentions; posts whose ``user_id`` is NULL get no user object.
    """
    u = users.select(
        F.col("user_id").alias("_uid"),
        F.struct(
            F.col("user_id").alias("id"), "screen_name", "followers_count", "friends_count",
            F.col("is_protected").alias("protected"), F.col("is_verified").alias("verified"),
        ).alias("user"),
    )
    j = statuses.join(u, statuses.user_id == u._uid, "left")
    obj = F.struct(
        F.col("status_id").alias("id"),
        api_time_string("created_at").alias("created_at"),
        "source", "text",
        F.struct(
            F.col("urls").alias("urls"),
            F.col("hashtags").alias("hashtags"),
            F.col("mentions").alias("user_mentions"),
        ).alias("entities"),
        "user",
    )
    return j.select(F.to_json(obj).alias("value"))


def read_status_json(spark: SparkSession, path: str) -> DataFrame:
    """Posts with an author; flattened to status_id, user_id, screen_name,
    created_ms (second precision, as in the JSON), source, entity counts."""
    raw = (
        spark.read.schema(schemas.STATUS_JSON)
        .option("mode", "PERMISSIVE")
        .json(path)
    )
    ok = raw.filter(F.col("user").isNotNull() & F.col("user.id").isNotNull())
    return ok.select(
        F.col("id").alias("status_id"),
        F.col("user.id").alias("user_id"),
        F.col("user.screen_name").alias("screen_name"),
        F.unix_millis(parse_api_time("created_at")).alias("created_ms"),
        "source",
        size0("entities.urls").alias("n_urls"),
        size0("entities.hashtags").alias("n_hashtags"),
        size0("entities.user_mentions").alias("n_mentions"),
    )
