"""The current label of every account as streaming state.

A streaming aggregation keeps, per account, the correction with the highest
sequence number in Spark's state store.  A micro-batch emits the accounts it
touched (update mode), each with its label after all events so far, so an
event that arrives late, with a lower sequence than one already seen, changes
nothing.  State and progress live in the checkpoint: a stream that is stopped
or lost in mid-batch goes on from there, and the batch that is repeated
replaces its own directory.

``labels.py`` resolves order when the table is read; here it is resolved once,
as events arrive, and a batch writes one row per touched account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift import schemas
from botsift.operators.dedupe import last_wins

_OUT = "user_id bigint, seq bigint, label string, batch_id bigint"


def current(events: DataFrame) -> DataFrame:
    """user_id, seq, label of the latest correction, for a stream or a table.
    Events without an account do not count."""
    return events.filter("user_id IS NOT NULL").groupBy("user_id").agg(
        F.max("seq").alias("seq"), F.max_by("label", "seq").alias("label"))


def start(spark: SparkSession, source_dir: str, table_dir: str, checkpoint: str, available_now: bool = True,
          max_files_per_trigger: int | None = None):
    reader = spark.readStream.schema(schemas.LABEL_EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir}/batch_id={batch_id}")

    w = current(reader.parquet(source_dir)).writeStream.outputMode("update").foreachBatch(write)
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read(spark: SparkSession, table_dir: str) -> DataFrame:
    """The table's accounts: each account's last batch."""
    rows = spark.read.schema(_OUT).parquet(table_dir)
    return last_wins(rows, "user_id", "batch_id").select("user_id", "seq", "label")


def run_in_two(spark: SparkSession, events: DataFrame, root: str, files: int = 2) -> DataFrame:
    """Drain ``events`` in two runs of one stream: the later half of each
    account's sequence first, then, resumed from the checkpoint, the rest,
    which arrives late."""
    src, table, ckpt = f"{root}/in", f"{root}/table", f"{root}/checkpoint"
    middle = events.agg(((F.min("seq") + F.max("seq")) / 2).alias("m")).select("m").scalar()
    for part in (F.col("seq") > middle, ~F.coalesce(F.col("seq") > middle, F.lit(False))):
        events.filter(part).select(*schemas.LABEL_EVENTS.fieldNames()).coalesce(files).write.mode("append").parquet(src)
        start(spark, src, table, ckpt).awaitTermination()
    return read(spark, table)
