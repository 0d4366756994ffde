"""Session construction and the shared scratch location.

Everything that is written and read back (text/JSON/CSV round trips, the
profile store, stream sinks, models) lives under the folder named by
``spark.checkpoint.dir``.  On a cluster that setting points at shared
storage; we only pick a folder of our own when it is unset (local runs and
tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "botsift", **conf: str) -> SparkSession:
    """A local session with settings sized for a single machine (tests, bench)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  A local master gets a folder of
    its own if none is set; on a cluster the setting is required, as executors
    do not share the driver's folders."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="botsift-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder.

    The folder is never reused, so concurrent or repeated runs do not clash
    and nothing has to be deleted first.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/botsift/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a DataFrame reading it back.

    Used before multi-pass work (indexer fits, forests, cross-validation):
    each pass then scans a columnar table instead of recomputing the whole
    lineage, and a lost executor only costs re-reading files, not
    recomputing shuffles.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
