"""Snapshots for append-only tables resolved by last-wins on read.

The profile store (one directory per ingest, ``version=<n>``) grows by
appends.  A snapshot ``<root>.snapshots/upto=<n>`` holds the resolved rows of
every partition up to n, committed with ``_SUCCESS``; readers take the latest
committed snapshot plus the partitions after it, pruned by their partition
value.  Nothing is deleted, and a failed snapshot is simply ignored.  (The
label table numbers its snapshots itself and says what each one covers, see
``botsift.streaming.labels``.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def snapshot_root(root: str) -> str:
    return f"{root.rstrip('/')}.snapshots"


def committed(spark: SparkSession, folder: str) -> bool:
    """Whether a write to this folder ended well (it has ``_SUCCESS``)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def latest_snapshot(spark: SparkSession, root: str) -> int | None:
    """Highest ``upto`` of a committed snapshot (listed on the JVM side)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(snapshot_root(root))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("upto=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            done.append(int(name.split("=", 1)[1]))
    return max(done) if done else None


def read_since_snapshot(spark: SparkSession, root: str, part_col: str, reader) -> DataFrame:
    """Rows of the latest snapshot plus the partitions after it.

    ``reader(path)`` reads one location with the table's schema; the
    appended partitions keep ``part_col``, snapshot rows get NULL there
    (they sort before any later partition in a last-wins by ``part_col``).
    """
    upto = latest_snapshot(spark, root)
    parts = reader(root)
    if upto is None:
        return parts
    snap = reader(f"{snapshot_root(root)}/upto={upto}")
    return parts.filter(parts[part_col] > upto).unionByName(snap, allowMissingColumns=True)


def write_snapshot(rows: DataFrame, root: str, upto: int) -> None:
    rows.write.mode("overwrite").parquet(f"{snapshot_root(root)}/upto={upto}")
