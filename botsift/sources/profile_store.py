"""Profile store: a Parquet table of account profiles keyed by user_id.

Replaces the reference's key-value cache.  Writes are appends of a new
``version`` (one directory per version, written in overwrite mode so a
retried batch replaces itself); reads resolve the latest row per user_id.
Ids that were looked up and not found are stored as tombstones
(state = 'missing') so they are not fetched again.

Latest-per-key is an aggregate (max_by over the version), not a window, so
Spark combines partially before the shuffle and a key with very many
versions never piles up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift import schemas
from botsift.functions.columns import DAY_MS
from botsift.sources import snapshots

FOUND, MISSING, UNSEEN = "found", "missing", "unseen"

PROFILE_JSON = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("features", schemas.FEATURES),
        T.StructField("marshalledUser", T.StringType()),
        T.StructField("marshalledTrainingStatuses", T.ArrayType(T.StringType())),
        T.StructField("marshalledUserTimeline", T.ArrayType(T.StringType())),
    ]
)


def write_version(rows: DataFrame, root: str, version: int) -> None:
    """Append one version of store rows.  A version that was written in full
    is never replaced; one that a failed batch left half done is."""
    if snapshots.committed(rows.sparkSession, f"{root}/version={version}"):
        raise ValueError(f"version {version} of the store is already there")
    out = rows.select(
        F.col("user_id").cast("bigint"), F.col("state"), F.col("label"), F.col("profile_json"),
    )
    out.write.mode("overwrite").parquet(f"{root}/version={version}")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """Latest row per user_id: the latest snapshot (if any) plus the
    versions written after it (older versions are pruned, not read)."""
    raw = snapshots.read_since_snapshot(
        spark, root, "version", lambda p: spark.read.schema(schemas.PROFILE_STORE).parquet(p))
    return latest(raw)


def compact_store(spark: SparkSession, root: str) -> int:
    """Snapshot the resolved store (``upto=<last version>``); the rows keep
    their own version numbers."""
    last = int(spark.read.schema(schemas.PROFILE_STORE).parquet(root).agg({"version": "max"}).collect()[0][0])
    snapshots.write_snapshot(read_store(spark, root), root, last)
    return last


def latest(rows: DataFrame, key: str = "user_id", order: str = "version") -> DataFrame:
    cols = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in cols])


def resolve(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Store rows for requested ids: 'found' with a profile, or a tombstone."""
    u = users.select("user_id", "label", F.to_json(F.struct(*users.columns)).alias("profile_json"))
    j = requests.select("user_id").distinct().join(u, "user_id", "left")
    return j.select(
        "user_id",
        F.when(F.col("profile_json").isNotNull(), F.lit(FOUND)).otherwise(F.lit(MISSING)).alias("state"),
        "label", "profile_json",
    )


def lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Three-way split of requested ids against the store:
    found (reuse), missing (known tombstone, skip), unseen (must be fetched)."""
    s = store.select("user_id", F.col("state").alias("_state"))
    return requests.select("user_id").join(s, "user_id", "left").select(
        "user_id", F.coalesce(F.col("_state"), F.lit(UNSEEN)).alias("state")
    )


def missing(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Tombstones: requested ids that are not accounts."""
    return (
        requests.select("user_id").join(users.select("user_id"), "user_id", "left_anti")
        .distinct().withColumn("state", F.lit(MISSING))
    )


def known(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requested ids already stored with a profile (no fetch needed)."""
    return requests.select("user_id").join(
        store.filter(F.col("state") == FOUND).select("user_id"), "user_id", "left_semi"
    )


# ----------------------------------------------------------- profile JSON
def raw_user() -> Column:
    """The account as JSON text."""
    return F.to_json(F.struct(
        F.col("user_id").alias("id"), "screen_name", "followers_count", "friends_count",
        F.col("is_protected").alias("protected"), F.col("is_verified").alias("verified")))


def raw_post() -> Column:
    """The post as JSON text, with its text and entities."""
    return F.to_json(F.struct(F.col("status_id").alias("id"), "created_ms", "source", "text", "urls", "hashtags", "mentions"))


def _raw_list(newest_first: bool) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(
        F.col("created_ms").alias("k1"), F.col("status_id").alias("k2"), raw_post().alias("j"))), asc=not newest_first)
    return F.transform(rows, lambda p: p["j"])


def encode_profiles(users: DataFrame, features: DataFrame, training: DataFrame) -> DataFrame:
    """One JSON document per account: label, features, the account's raw JSON
    and the raw JSON of its training posts (``training``: posts with the
    account that lists them as ``owner``, at most a few each).  Returns
    user_id, chunk (NULL), profile_json and ``raw``, the raw texts in it."""
    t = training.groupBy(F.col("owner").alias("user_id")).agg(_raw_list(False).alias("_t"))
    feats = features.select(F.col("id").alias("user_id"), F.struct(*fx_cols(features)).alias("features"))
    none = F.array().cast("array<string>")
    j = users.select("user_id", "label", raw_user().alias("marshalledUser")).join(feats, "user_id", "left").join(
        t, "user_id", "left").withColumn("_t", F.coalesce("_t", none))
    doc = F.struct("user_id", "label", "features", "marshalledUser", F.col("_t").alias("marshalledTrainingStatuses"))
    return j.select("user_id", F.lit(None).cast("bigint").alias("chunk"), F.to_json(doc).alias("profile_json"),
                    F.concat(F.array("marshalledUser"), "_t").alias("raw"))


def encode_timelines(timeline: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """The timelines of the profiles: one JSON document per account and time
    chunk (a day; chunk -1 holds posts without a time), newest post first,
    so that no document grows with an account's whole history."""
    chunk = F.coalesce(F.floor(F.col("created_ms") / chunk_ms), F.lit(-1)).cast("bigint").alias("chunk")
    g = timeline.groupBy("user_id", chunk).agg(_raw_list(True).alias("_p"))
    doc = F.struct("user_id", "chunk", F.col("_p").alias("marshalledUserTimeline"))
    return g.select("user_id", "chunk", F.to_json(doc).alias("profile_json"), F.col("_p").alias("raw"))


def fx_cols(features: DataFrame) -> list[str]:
    return [c for c in schemas.FEATURES.fieldNames() if c in features.columns]


def decode_profiles(docs: DataFrame) -> DataFrame:
    """Parse JSON documents (column ``value``) of both kinds back into
    columns; an undecodable document lands in the corrupt-record field and is
    dropped.  ``raw`` has the raw texts, user first, as they were stored."""
    schema = T.StructType([*PROFILE_JSON.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    p = docs.select(parsed.alias("p")).filter(F.col("p").isNotNull() & F.col("p._corrupt").isNull())
    user = F.from_json("p.marshalledUser", schemas.USER)
    ids = lambda c: F.transform(c, lambda s: F.get_json_object(s, "$.id").try_cast("bigint"))
    none = F.array().cast("array<string>")
    training, posts = (F.coalesce(f"p.marshalled{x}", none) for x in ("TrainingStatuses", "UserTimeline"))
    own = F.when(F.col("p.marshalledUser").isNull(), none).otherwise(F.array("p.marshalledUser"))
    return p.select(
        F.col("p.user_id").alias("user_id"), F.col("p.chunk").alias("chunk"), F.col("p.label").alias("label"),
        user["screen_name"].alias("screen_name"), user["followers_count"].alias("followers_count"),
        F.col("p.features").alias("features"), ids(training).alias("training_ids"), ids(posts).alias("timeline_ids"),
        F.concat(own, training, posts).alias("raw"))
