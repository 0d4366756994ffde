"""Copy-on-write profile store: an upsert rewrites the buckets it touches.

The log-structured store (``profile_store``) is cheap to write and resolves
its versions on every read.  Here reading costs one scan and writing pays:

* rows live in ``data/version=<v>/bucket=<b>``, the bucket being a hash of
  the account id; a written file is never changed;
* ``manifest/version=<v>`` is a small table that says, for every bucket, the
  version whose files hold it.  It is written last and counts only with its
  ``_SUCCESS``, so a batch that fails before leaves the old manifest valid,
  and its files are replaced when the batch is repeated.

An upsert reads and rewrites the touched buckets only; a lookup opens the
buckets of its requests only.  Every committed version stays readable.  There
is one writer at a time, and versions grow.  A bucket is merged and written
by one task: choose their number so that a bucket is a few hundred MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.session import materialize
from botsift.sources.snapshots import committed

BUCKETS = 16  # of a store, for good; a large one wants thousands

ROWS = "user_id bigint, version bigint, state string, label string, profile_json string"
MANIFEST = "bucket int, buckets int, written bigint, n_rows bigint"


def bucket_of(key: str = "user_id", buckets: int = BUCKETS) -> Column:
    """The bucket of an id, the same in every engine that has MD5."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit("bucket|"), F.col(key).cast("string"))), 1, 8), 16, 10)
    return F.pmod(digits.cast("bigint"), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("version=") and committed(spark, f"{root}/manifest/{n}"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """bucket, buckets (of the store), written (the version that holds the
    bucket), n_rows, as of a version (the last by default)."""
    done = versions(spark, root)
    if version is None and not done:
        return spark.createDataFrame([], MANIFEST)
    v = done[-1] if version is None else version
    if v not in done:
        raise ValueError(f"version {v} of the store is not committed")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={v}")


def _held(m: DataFrame) -> tuple[dict[int, int], int | None]:
    """Bucket -> version that holds it, and the store's number of buckets
    (None while it has no row); a manifest has one row per bucket."""
    rows = m.collect()
    return {r["bucket"]: r["written"] for r in rows}, rows[0]["buckets"] if rows else None


def _open(spark: SparkSession, root: str, held: dict[int, int]) -> DataFrame:
    """Rows of the given buckets, from the versions that hold them."""
    if not held:
        return spark.createDataFrame([], ROWS)
    # without a base path, folder names are no columns: a row's version is that of the commit that wrote it
    return spark.read.schema(ROWS).parquet(*[f"{root}/data/version={v}/bucket={b}" for b, v in sorted(held.items())])


def read(spark: SparkSession, root: str, requests: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """The store, whole or the rows of the requested ids (``requests``: any
    user_ids, repeated or NULL), as of a version (the last by default)."""
    held, width = _held(manifest(spark, root, version))
    if requests is None or not held:
        return _open(spark, root, held)
    ids = requests.filter("user_id IS NOT NULL").select("user_id").distinct()
    wanted = {r[0] for r in ids.select(bucket_of(buckets=width).alias("b")).distinct().collect()}
    return _open(spark, root, {b: v for b, v in held.items() if b in wanted}).join(ids, "user_id", "left_semi")


def upsert(changes: DataFrame, root: str, version: int, buckets: int = BUCKETS) -> list[int]:
    """Commit ``changes`` (user_id, state, label, profile_json) as
    ``version`` and return the buckets it rewrote.

    Rows without an id are no profiles and are left out; of several rows of
    one id in a batch the greatest (state, label, JSON) stays; an empty batch
    commits a manifest alone.
    """
    spark = changes.sparkSession
    done = versions(spark, root)
    if done and version <= done[-1]:
        raise ValueError(f"version {version} is not after version {done[-1]} of the store")
    before = manifest(spark, root)
    held, width = _held(before)
    if width not in (None, buckets):
        raise ValueError(f"the store has {width} buckets, not {buckets}")
    new = materialize(changes.filter("user_id IS NOT NULL").select(
        F.col("user_id").cast("bigint"), F.lit(version).cast("bigint").alias("version"), "state", "label", "profile_json"), "store-changes")
    bucket = bucket_of(buckets=buckets).alias("bucket")
    touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # numbers below ``buckets``
    old = _open(spark, root, {b: held[b] for b in touched if b in held})
    data = f"{root}/data/version={version}"
    row = F.struct("version", "state", "label", "profile_json")
    rows = old.unionByName(new).select("*", bucket).repartition(max(len(touched), 1), "bucket")
    (rows.groupBy("bucket", "user_id").agg(F.max(row).alias("r")).select("user_id", "r.*", "bucket")
     .sortWithinPartitions("bucket", "user_id").write.mode("overwrite").partitionBy("bucket").parquet(data))
    counted = spark.read.schema("user_id bigint, bucket int").parquet(data).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    now = counted.select("bucket", F.lit(buckets).alias("buckets"), F.lit(version).cast("bigint").alias("written"), "n_rows")
    kept = before.filter(~F.col("bucket").isin(touched)) if touched else before
    _commit(kept.unionByName(now), root, version)
    return touched


def _commit(rows: DataFrame, root: str, version: int) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
