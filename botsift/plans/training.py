"""End-to-end training run (the reference's main job), as Spark jobs.

labelled file -> last-line-wins per account -> resolve to accounts
(unresolved ids become tombstones) -> label corrections override file
labels -> features (reusing stored feature rows when given) -> feature
table written once -> grid search by cross-validation on the training split
-> evaluation of the best forest -> one saved PipelineModel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.operators import features as fx
from botsift.operators import model as ml
from botsift.operators import resolve
from botsift.session import materialize, scratch_path
from botsift.sources import labelled as lb
from botsift.sources import profile_store as ps


@dataclass
class TrainingRun:
    features: DataFrame       # materialized feature table (with label_source)
    tombstones: DataFrame     # requested ids that are not accounts
    quarantine: DataFrame     # malformed labelled lines
    model: PipelineModel
    evaluation: DataFrame     # accuracy, test_error, n_test
    model_path: str | None


def build_models(
    spark: SparkSession,
    labelled_path: str,
    users: DataFrame,
    statuses: DataFrame,
    label_events: DataFrame | None = None,
    stored_features: DataFrame | None = None,
    model_path: str | None = None,
    n: int | None = None,
    num_trees: int | tuple = ml.GRID_NUM_TREES,
    max_depth: int | tuple = ml.GRID_MAX_DEPTH,
    folds: int = ml.NUM_FOLDS,
) -> TrainingRun:
    """Train on the accounts of a labelled file.

    Tuples of tree numbers and depths are searched by cross-validation and
    the best forest is kept; single values train that forest.  ``n`` limits
    every account to its n newest posts (all by default).
    """
    accounts, quarantine = lb.read_labelled(spark, labelled_path, mode="quarantine")
    accounts = lb.dedupe_accounts(accounts)
    resolved = resolve.resolve_users(accounts, users)
    tombstones = ps.missing(accounts, users)

    file_labels = resolved.select("user_id", "label")
    if label_events is not None:
        labels = resolve.effective_labels(file_labels, resolve.current_labels(label_events))
    else:
        labels = file_labels.withColumn("label_source", F.lit("file"))
    accts = resolved.drop("label").join(labels, "user_id")

    if stored_features is not None:
        feats = resolve.feature_reuse(accts.drop("label_source"), statuses, stored_features, n)
        feats = feats.drop("label", "origin").join(
            labels.select(F.col("user_id").alias("id"), "label"), "id")
    else:
        # only the labelled accounts' posts go any further
        feats = fx.user_features(accts.drop("label_source"), resolve.posts_of(statuses, accts), n=n)
    feats = feats.join(labels.select(F.col("user_id").alias("id"), "label_source"), "id")
    feats = materialize(feats, "training-features")

    rows = feats.drop("label_source")
    if isinstance(num_trees, tuple) or isinstance(max_depth, tuple):
        as_tuple = lambda x: x if isinstance(x, tuple) else (x,)
        model, _, test, _ = ml.train_best(rows, materialized=True, num_trees=as_tuple(num_trees),
                                          max_depth=as_tuple(max_depth), folds=folds)
    else:
        model, _, test = ml.train_forest(rows, num_trees, max_depth, materialized=True)
    evaluation = ml.evaluate(model, test)
    if model_path is None:
        model_path = scratch_path(spark, "model")
    model.write().overwrite().save(model_path)
    return TrainingRun(feats, tombstones, quarantine, model, evaluation, model_path)
