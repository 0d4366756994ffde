"""Hand-built inputs for golden-row tests (createDataFrame is test-only)."""

from pyspark.sql import types as T

USERS_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("screen_name", T.StringType()),
    T.StructField("followers_count", T.LongType()),
    T.StructField("friends_count", T.LongType()),
    T.StructField("is_protected", T.BooleanType()),
    T.StructField("is_verified", T.BooleanType()),
    T.StructField("label", T.StringType()),
])

URL = T.StructType([T.StructField("url", T.StringType()), T.StructField("expanded_url", T.StringType())])

STATUS_SCHEMA = T.StructType([
    T.StructField("status_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("created_ms", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("urls", T.ArrayType(URL)),
    T.StructField("hashtags", T.ArrayType(T.StringType())),
    T.StructField("mentions", T.ArrayType(T.StringType())),
])


def user(uid, followers=0, friends=0, protected=False, verified=False, name="abc", label="human"):
    return (uid, name, followers, friends, protected, verified, label)


def post(sid, uid, ms=None, source="web", n_urls=0, n_tags=0, n_ment=0):
    return (sid, uid, ms, source, [("u", "e")] * n_urls, ["#t"] * n_tags, ["@m"] * n_ment)


def frames(spark, users, posts):
    return (spark.createDataFrame(users, USERS_SCHEMA), spark.createDataFrame(posts, STATUS_SCHEMA))
