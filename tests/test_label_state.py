"""The stateful label stream: restarts, late events and repeated batches."""

from pyspark.sql import functions as F

from botsift import schemas
from botsift.session import scratch_path
from botsift.streaming import label_state as ls


def land(spark, rows, src):
    spark.createDataFrame(rows, schemas.LABEL_EVENTS).coalesce(1).write.mode("append").parquet(src)


def test_resumed_stream_remembers_and_ignores_late_events(spark):
    root = scratch_path(spark, "t-label-state")
    src, table, ckpt = f"{root}/in", f"{root}/table", f"{root}/checkpoint"
    land(spark, [(5, 1, "bot"), (3, 2, "human"), (9, 3, "bot"), (4, None, "bot")], src)
    ls.start(spark, src, table, ckpt).awaitTermination()
    land(spark, [(2, 1, "human"), (8, 2, "bot"), (1, 4, "human"), (7, 2, "human")], src)
    ls.start(spark, src, table, ckpt).awaitTermination()
    # the resumed run emits the touched accounts with what the state knew from the first run
    second = spark.read.parquet(table).filter(F.col("batch_id") == 1)
    assert {(r["user_id"], r["seq"], r["label"]) for r in second.collect()} == {(1, 5, "bot"), (2, 8, "bot"), (4, 1, "human")}
    want = {(1, 5, "bot"), (2, 8, "bot"), (3, 9, "bot"), (4, 1, "human")}
    assert {tuple(r) for r in ls.read(spark, table).select("user_id", "seq", "label").collect()} == want
    ls.start(spark, src, table, ckpt).awaitTermination()  # nothing new: nothing changes
    assert {tuple(r) for r in ls.read(spark, table).select("user_id", "seq", "label").collect()} == want


def test_a_lost_batch_is_repeated_in_place(spark):
    root = scratch_path(spark, "t-label-state")
    src, table, ckpt = f"{root}/in", f"{root}/table", f"{root}/checkpoint"
    land(spark, [(1, 1, "bot"), (2, 2, "bot")], src)
    ls.start(spark, src, table, ckpt).awaitTermination()
    land(spark, [(3, 1, "human")], src)
    ls.start(spark, src, table, ckpt).awaitTermination()
    # the last batch is taken back, as if the job had died between writing and committing
    jvm = spark._jvm
    commit = jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits/1")
    fs = commit.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(commit, False)
    ls.start(spark, src, table, ckpt).awaitTermination()
    got = sorted(tuple(r) for r in ls.read(spark, table).select("user_id", "seq", "label").collect())
    assert got == [(1, 3, "human"), (2, 2, "bot")]
    assert spark.read.parquet(table).count() == 3
