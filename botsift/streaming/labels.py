"""Label corrections as a stream, folded into a label table.

Each micro-batch is reduced to its latest correction per account (a partial
aggregate) and written to its own directory ``query=<id>/batch_id=<n>`` in
overwrite mode, so a replayed batch after a failure replaces itself
(idempotent) and two streams never replace each other's batches.
Readers resolve the current label across batches by the event sequence, so
the result does not depend on batch order either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift import schemas
from botsift.operators.dedupe import last_wins
from botsift.sources import snapshots


_TABLE = T.StructType([*schemas.LABEL_EVENTS.fields, T.StructField("query", T.StringType()),
                       T.StructField("batch_id", T.LongType())])


def start_label_upsert(spark: SparkSession, source_dir: str, table_dir: str, checkpoint: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None):
    reader = spark.readStream.schema(schemas.LABEL_EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(source_dir)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # the id belongs to the checkpoint: a stream that is resumed keeps it,
        # one with a new checkpoint counts its batches in a folder of its own
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        last_wins(batch, "user_id", "seq").write.mode("overwrite").parquet(
            f"{table_dir}/query={query}/batch_id={batch_id}"
        )

    w = events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _batches(spark: SparkSession, table_dir: str) -> DataFrame:
    return spark.read.schema(_TABLE).parquet(table_dir)


def _uncovered(spark: SparkSession, table_dir: str, number: int | None) -> DataFrame:
    """The batches that snapshot ``number`` does not hold, pruned by their
    partition values (one range per stream that ever wrote to the table)."""
    raw = _batches(spark, table_dir)
    if number is None:
        return raw
    covered = spark.read.parquet(f"{snapshots.snapshot_root(table_dir)}/covered={number}").collect()
    for r in covered:
        raw = raw.filter((F.col("query") != r["query"]) | (F.col("batch_id") > r["upto"]))
    return raw


def read_labels(spark: SparkSession, table_dir: str) -> DataFrame:
    """Current label per account: the latest snapshot (if any) plus the
    batches that it does not hold."""
    number = snapshots.latest_snapshot(spark, table_dir)
    cols = schemas.LABEL_EVENTS.fieldNames()
    raw = _uncovered(spark, table_dir, number).select(*cols)
    if number is not None:
        old = spark.read.schema(schemas.LABEL_EVENTS).parquet(f"{snapshots.snapshot_root(table_dir)}/upto={number}")
        raw = raw.unionByName(old.select(*cols))
    return last_wins(raw, "user_id", "seq").select("user_id", "seq", "label")


def compact(spark: SparkSession, table_dir: str) -> int:
    """Write the next snapshot: the resolved labels, and the last batch of
    every stream that they hold (written first, so that a snapshot is only
    used once both are there)."""
    number = (snapshots.latest_snapshot(spark, table_dir) or 0) + 1
    held = _batches(spark, table_dir).groupBy("query").agg(F.max("batch_id").alias("upto")).coalesce(1)
    held.write.mode("overwrite").parquet(f"{snapshots.snapshot_root(table_dir)}/covered={number}")
    covered = spark.read.parquet(f"{snapshots.snapshot_root(table_dir)}/covered={number}").collect()
    rows = _batches(spark, table_dir)
    within = F.lit(False)
    for r in covered:  # not what has arrived since
        within = within | ((F.col("query") == r["query"]) & (F.col("batch_id") <= r["upto"]))
    last = snapshots.latest_snapshot(spark, table_dir)
    rows = rows.filter(within).select(*schemas.LABEL_EVENTS.fieldNames())
    if last is not None:
        rows = rows.unionByName(spark.read.schema(schemas.LABEL_EVENTS).parquet(f"{snapshots.snapshot_root(table_dir)}/upto={last}"))
    snapshots.write_snapshot(last_wins(rows, "user_id", "seq"), table_dir, number)
    return number


def write_event_files(events: DataFrame, source_dir: str, files: int = 4) -> None:
    """Land an event table as a few files (the stream's input)."""
    events.repartition(files).write.mode("overwrite").parquet(source_dir)


def run_once(spark: SparkSession, events: DataFrame, root: str, files_per_batch: int | None = 1,
             source: str = "in") -> DataFrame:
    """Land ``events`` as files, drain them through the stream (one file per
    micro-batch by default, so the upsert runs over several batches) and
    return the resolved label table.  ``source`` names the stream: its input
    folder and its checkpoint."""
    src, table, ckpt = f"{root}/{source}", f"{root}/labels", f"{root}/checkpoint-{source}"
    write_event_files(events, src)
    q = start_label_upsert(spark, src, table, ckpt, available_now=True,
                           max_files_per_trigger=files_per_batch)
    q.awaitTermination()
    return read_labels(spark, table)


__all__ = ["start_label_upsert", "read_labels", "run_once"]
