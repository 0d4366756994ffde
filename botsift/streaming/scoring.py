"""Account scoring as a stream: feature rows in, predictions out.

The fitted PipelineModel is loaded once per query; its stages are
stateless transformers, so the streaming plan is a projection per
micro-batch and the file sink commits through the checkpoint (exactly-once
output files).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from botsift import schemas
from botsift.operators import model as ml
from botsift.operators.forest import Forest


def start_scoring(spark: SparkSession, model_path: str, source_dir: str, out_dir: str,
                  checkpoint: str, available_now: bool = True):
    model = PipelineModel.load(model_path)
    feats = spark.readStream.schema(schemas.FEATURES).option("maxFilesPerTrigger", 1).parquet(source_dir)
    scored = ml.score(model, feats)
    w = scored.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_walk(spark: SparkSession, forest: Forest, source_dir: str, out_dir: str, checkpoint: str, available_now: bool = True):
    """Scoring by walking a forest's node table.  Its last step gathers the
    trees' votes of an account, so every micro-batch is scored as a table
    and written to a directory of its own, which a replay replaces."""
    feats = spark.readStream.schema(schemas.FEATURES).option("maxFilesPerTrigger", 1).parquet(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        forest.score(batch).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = feats.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_walk_once(spark: SparkSession, forest: Forest, features: DataFrame, root: str) -> DataFrame:
    features.select(*schemas.FEATURES.fieldNames()).repartition(4).write.mode("overwrite").parquet(f"{root}/in")
    start_walk(spark, forest, f"{root}/in", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch_id")


def run_once(spark: SparkSession, model_path: str, features: DataFrame, root: str) -> DataFrame:
    src, out, ckpt = f"{root}/in", f"{root}/out", f"{root}/checkpoint"
    features.select(*schemas.FEATURES.fieldNames()).repartition(4).write.mode("overwrite").parquet(src)
    q = start_scoring(spark, model_path, src, out, ckpt, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out)
