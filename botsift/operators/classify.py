"""Classify accounts by id: stored features or fresh ones, then the model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift import schemas
from botsift.operators import features as fx
from botsift.operators import model as ml
from botsift.operators.forest import Forest
from botsift.operators.resolve import posts_of


def classify(model: PipelineModel | Forest, ids: DataFrame, users: DataFrame, statuses: DataFrame,
             stored: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """One row per requested id (column ``user_id``, repeats count once):
    id, state, predictedLabel, probability and the account's feature row.

    ``state`` is 'stored' (features reused), 'computed' (from the account's
    posts; only those posts are read beyond the join) or 'missing' (not an
    account; no label).
    """
    want = ids.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    cols = [c for c in schemas.FEATURES.fieldNames() if c != "label"]
    todo = users.join(want, "user_id", "left_semi")
    if stored is not None:
        todo = todo.join(stored.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    feats = fx.user_features(todo, posts_of(statuses, todo), n=n).select(*cols).withColumn("state", F.lit("computed"))
    if stored is not None:
        old = stored.join(want.withColumnRenamed("user_id", "id"), "id", "left_semi")
        feats = feats.unionByName(old.select(*cols).withColumn("state", F.lit("stored")))
    keep = [c for c in feats.columns if c != "id"]
    scored = model.score(feats, keep) if isinstance(model, Forest) else ml.score(model, feats, keep).drop("prediction")
    return want.withColumnRenamed("user_id", "id").join(scored, "id", "left").withColumn(
        "state", F.coalesce("state", F.lit("missing")))
