"""Explicit schemas.  Nothing in the library infers a schema from data."""

from pyspark.sql import types as T

URL_ENTITY = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("expanded_url", T.StringType())]
)

# Account record as kept by the profile store and the JSON status file.
USER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("screen_name", T.StringType()),
        T.StructField("followers_count", T.LongType()),
        T.StructField("friends_count", T.LongType()),
        T.StructField("protected", T.BooleanType()),
        T.StructField("verified", T.BooleanType()),
    ]
)

# One post in the public v1.1 JSON layout (only the attributes we use).
STATUS_JSON = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField(
            "entities",
            T.StructType(
                [
                    T.StructField("urls", T.ArrayType(URL_ENTITY)),
                    T.StructField("hashtags", T.ArrayType(T.StringType())),
                    T.StructField("user_mentions", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("user", USER),
    ]
)

# The feature table: the one tabular contract between extraction and the model.
# Column names and order are the reference's (fixed values).
FEATURE_COLUMNS = [
    "id", "label", "isProtected", "isVerified", "meanIA", "tweetRate",
    "maxTweetRate", "screenNameLength", "followerRatio", "urlRatio",
    "hashtagRatio", "mentionRatio", "uniqueDevices", "mainDeviceCount",
    "mainDevice",
]

# Model inputs, in vector order (fixed values).
MODEL_INPUTS = [
    "isProtected", "isVerified", "meanIA", "tweetRate", "maxTweetRate",
    "screenNameLength", "followerRatio", "urlRatio", "hashtagRatio",
    "mentionRatio", "uniqueDevices", "mainDeviceCount", "indexedMainDevice",
]

FEATURES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("isProtected", T.DoubleType()),
        T.StructField("isVerified", T.DoubleType()),
        T.StructField("meanIA", T.DoubleType()),
        T.StructField("tweetRate", T.DoubleType()),
        T.StructField("maxTweetRate", T.LongType()),
        T.StructField("screenNameLength", T.LongType()),
        T.StructField("followerRatio", T.DoubleType()),
        T.StructField("urlRatio", T.DoubleType()),
        T.StructField("hashtagRatio", T.DoubleType()),
        T.StructField("mentionRatio", T.DoubleType()),
        T.StructField("uniqueDevices", T.LongType()),
        T.StructField("mainDeviceCount", T.LongType()),
        T.StructField("mainDevice", T.StringType()),
    ]
)

PROFILE_STORE = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("state", T.StringType()),  # found | missing
        T.StructField("label", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("profile_json", T.StringType()),
    ]
)

LABEL_EVENTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("label", T.StringType()),
    ]
)
