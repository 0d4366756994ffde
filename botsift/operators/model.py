"""Account classifier: one Spark ML pipeline from feature table to label.

Stages (fit once, saved and served as one PipelineModel):
  device indexer (mainDevice -> indexedMainDevice, unseen devices kept)
  vector assembler (13 inputs, fixed order)
  label indexer (fit on all labelled rows, as the reference does)
  vector indexer (maxCategories 4, unseen categories kept)
  random forest
  index-to-string (prediction -> predictedLabel with the fitted labels)
The label indexer is skipped at scoring time when rows carry no label.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from botsift.schemas import MODEL_INPUTS
from botsift.session import materialize

# Fixed values of the reference training set-up.
SEED = 207325481
MIN_MAX_BINS = 280
TRAIN_FRACTION = 0.6
MAX_CATEGORIES = 4
NUM_FOLDS = 4
GRID_NUM_TREES = (10, 100, 1)
GRID_MAX_DEPTH = (None, 5, 10, 1)  # None = the forest's default depth
PREPARED = ("indexedFeatures", "indexedLabel")   # a forest's inputs


def device_indexer(features: DataFrame, input_col: str = "mainDevice"):
    return StringIndexer(inputCol=input_col, outputCol="indexedMainDevice",
                         handleInvalid="keep").fit(features)


def label_indexer(features: DataFrame):
    return StringIndexer(inputCol="label", outputCol="indexedLabel").fit(features)


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(MODEL_INPUTS), outputCol="features")


def split_flag(id_col: str = "id", train_fraction: float = TRAIN_FRACTION):
    """Deterministic train/test assignment from an md5 of the id (does not
    depend on partitioning, unlike randomSplit)."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.when(h % 1_000_000 < round(train_fraction * 1_000_000), F.lit("train")).otherwise(F.lit("test"))


def split(features: DataFrame, train_fraction: float = TRAIN_FRACTION) -> tuple[DataFrame, DataFrame]:
    s = features.withColumn("_split", split_flag("id", train_fraction))
    return (s.filter("_split = 'train'").drop("_split"), s.filter("_split = 'test'").drop("_split"))


def forest_pipeline(features: DataFrame, train: DataFrame, num_trees: int = 20,
                    max_depth: int = 5, seed: int = SEED) -> tuple[Pipeline, RandomForestClassifier]:
    """Build the pipeline.  Labels are indexed on all rows; the device index
    is fit on the training rows, with room for unseen devices; maxBins grows
    with the devices, so every device keeps a category of its own."""
    dev = device_indexer(train)
    lab = label_indexer(features)
    max_bins = max(MIN_MAX_BINS, len(dev.labels) + 1)
    rf = RandomForestClassifier(labelCol="indexedLabel", featuresCol="indexedFeatures",
                                seed=seed, maxBins=max_bins, numTrees=num_trees, maxDepth=max_depth)
    stages = [
        dev, assembler(), lab,
        VectorIndexer(inputCol="features", outputCol="indexedFeatures",
                      maxCategories=MAX_CATEGORIES, handleInvalid="keep"),
        rf,
        IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=lab.labels),
    ]
    return Pipeline(stages=stages), rf


def train_forest(features: DataFrame, num_trees: int = 20, max_depth: int = 5,
                 seed: int = SEED, materialized: bool = False) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit on the deterministic training split; returns (model, train, test).

    The feature table is written once to the shared folder first (unless the
    caller already did), since fitting makes several passes over it.
    """
    if not materialized:
        features = materialize(features, "features")
    train, test = split(features)
    pipe, _ = forest_pipeline(features, train, num_trees, max_depth, seed)
    return pipe.fit(train), train, test


def forest_of(model: PipelineModel):
    return next(s for s in model.stages if isinstance(s, RandomForestClassificationModel))


def score(model: PipelineModel, features: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Predicted label and its probability for any number of accounts (and
    the columns ``keep``).  The label column is dropped first: scoring never
    needs (or trusts) it."""
    rows = features.drop("label") if "label" in features.columns else features
    out = model.transform(rows)
    p = vector_to_array("probability")
    return out.select(
        "id", "predictedLabel",
        F.element_at(p, F.col("prediction").cast("int") + 1).alias("probability"),
        "prediction", *keep,
    )


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """accuracy, test_error and n_test on held-out rows, as an aggregate."""
    acc = accuracy_table(model.transform(test))
    return acc.select("accuracy", (1 - F.col("accuracy")).alias("test_error"), F.col("n").alias("n_test"))


def accuracy_table(pred: DataFrame, label_col: str = "label", pred_col: str = "predictedLabel") -> DataFrame:
    """Accuracy as an aggregate over (label, prediction) pairs."""
    return pred.agg(
        F.avg(F.when(F.col(label_col) == F.col(pred_col), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion_matrix(pred: DataFrame, label_col: str = "label", pred_col: str = "predictedLabel") -> DataFrame:
    return pred.groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def misclassified(pred: DataFrame, label_col: str = "label", pred_col: str = "predictedLabel") -> DataFrame:
    """The labelled rows whose prediction is another label."""
    return pred.filter(F.col(label_col) != F.col(pred_col))


def fold(id_col: str, folds: int):
    """The row's cross-validation fold, from an md5 of its id (independent
    of the train/test assignment and of partitioning)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("fold|"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return (h % folds).cast("int")


def param_grid(rf: RandomForestClassifier, num_trees=GRID_NUM_TREES, max_depth=GRID_MAX_DEPTH):
    """The reference grid with duplicates removed (the default depth, 5,
    appears twice, so 12 maps collapse to 9)."""
    depths = sorted({rf.getMaxDepth() if d is None else d for d in max_depth})
    b = ParamGridBuilder().addGrid(rf.numTrees, list(num_trees)).addGrid(rf.maxDepth, depths)
    return b.build()


def prepared(indexer: VectorIndexer, rows: DataFrame):
    """The vector indexer fitted on ``rows``, and the forest's own inputs,
    persisted: every forest of a search reads these."""
    model = indexer.fit(rows)
    return model, model.transform(rows).select(*PREPARED).persist()


def cross_validate(features: DataFrame, num_trees=GRID_NUM_TREES, max_depth=GRID_MAX_DEPTH,
                   folds: int = NUM_FOLDS, parallelism: int = 4, seed: int = SEED, materialized: bool = False,
                   keep_models: bool = False):
    """k-fold grid search on the training split, with folds that depend on
    the ids alone (``fold``); returns (cv model, table of (numTrees,
    maxDepth, avg accuracy, is_best)).  ``keep_models`` keeps every fold's
    forests, for ``out_of_fold``.

    The grid only varies the forest: devices, labels and vectors are made
    once, and the vector indexer is fitted once per fold, not once per point
    of the grid."""
    if not materialized:
        features = materialize(features, "features")
    train, _ = split(features)
    train = train.withColumn("fold", fold("id", folds))
    pipe, rf = forest_pipeline(features, train, seed=seed)
    grid = param_grid(rf, num_trees, max_depth)
    ev = MulticlassClassificationEvaluator(labelCol="indexedLabel", predictionCol="prediction",
                                           metricName="accuracy")
    *before, indexer, _, after = pipe.getStages()
    before = Pipeline(stages=before).fit(train)  # these are fitted already, on all rows
    rows = before.transform(train).select("features", "indexedLabel", "fold").persist()
    metrics, kept = [[0.0] * folds for _ in grid], [[None] * len(grid) for _ in range(folds)]
    for k in range(folds):
        vec, seen = prepared(indexer, rows.filter(F.col("fold") != k))
        unseen = vec.transform(rows.filter(F.col("fold") == k)).select(*PREPARED).persist()
        models = rf.fitMultiple(seen, grid)

        def one(_):
            i, model = next(models)
            metrics[i][k] = ev.evaluate(model.transform(unseen).select("indexedLabel", "prediction"))
            if keep_models:
                kept[k][i] = PipelineModel([*before.stages, vec, model, after])

        with ThreadPool(parallelism) as pool:
            pool.map(inheritable_thread_target(features.sparkSession)(one), range(len(grid)), chunksize=1)
        seen.unpersist()
        unseen.unpersist()
    average = [sum(m) / folds for m in metrics]
    best = max(range(len(grid)), key=lambda i: average[i])
    vec, seen = prepared(indexer, rows)
    cvm = CrossValidatorModel(PipelineModel([*before.stages, vec, rf.fit(seen, grid[best]), after]), average,
                              kept if keep_models else None)
    seen.unpersist()
    rows.unpersist()
    rows = [
        (int(pm[rf.numTrees]), int(pm[rf.maxDepth]), float(m), i == best)
        for i, (pm, m) in enumerate(zip(grid, average))
    ]
    table = features.sparkSession.createDataFrame(
        rows, "numTrees int, maxDepth int, avg_accuracy double, is_best boolean"
    )
    return cvm, table


def out_of_fold(cvm, train: DataFrame, folds: int = NUM_FOLDS) -> DataFrame:
    """(id, fold, numTrees, maxDepth, label, predictedLabel): every training
    row as the forests that were not fitted on its fold predict it, for each
    point of the grid.  Needs a search with ``keep_models``."""
    rows = train.withColumn("fold", fold("id", folds))
    parts = []
    for i, models in enumerate(cvm.subModels):
        for m in models:
            trees, depth = best_params(m)
            parts.append(m.transform(rows.filter(F.col("fold") == i)).select(
                "id", "fold", F.lit(trees).alias("numTrees"), F.lit(depth).alias("maxDepth"), "label", "predictedLabel"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_best(features: DataFrame, materialized: bool = False, **grid) -> tuple[PipelineModel, DataFrame, DataFrame, DataFrame]:
    """Grid search as the reference trains: cross-validation on the training
    split, the best forest refitted on all of it.  Returns (model, train,
    test, table of the grid)."""
    if not materialized:
        features = materialize(features, "features")
    cvm, table = cross_validate(features, materialized=True, **grid)
    train, test = split(features)
    return cvm.bestModel, train, test, table


def best_params(model: PipelineModel) -> tuple[int, int]:
    """(trees, depth) that the model's forest was trained with."""
    rf = forest_of(model)
    return int(rf.getNumTrees), int(rf.getOrDefault("maxDepth"))


def feature_importance(model: PipelineModel) -> DataFrame:
    imp = forest_of(model).featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(MODEL_INPUTS, map(float, imp))),
                                 "feature string, importance double")


def tree_summary(model: PipelineModel) -> DataFrame:
    rf = forest_of(model)
    spark = SparkSession.getActiveSession()
    rows = [(i, int(t.numNodes), int(t.depth), float(w))
            for i, (t, w) in enumerate(zip(rf.trees, rf.treeWeights))]
    return spark.createDataFrame(rows, "tree int, num_nodes int, depth int, weight double")
