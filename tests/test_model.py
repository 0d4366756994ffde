"""Model tests: save/load equality, unseen devices, conservation of rows,
"""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from botsift.operators import features as fx
from botsift.operators import model as ml
from botsift.session import scratch_path
from botsift.sources import fixtures as fix


@pytest.fixture(scope="module")
def trained(spark):
    sf = "/root/testdata/sf0.01"
    f = fx.user_features(fix.users(spark, sf), fix.statuses(spark, sf)).cache()
    model, train, test = ml.train_forest(f, num_trees=10, max_depth=4)
    return f, model, train, test


def test_split_conserves_rows(trained):
    f, _, train, test = trained
    assert train.count() + test.count() == f.count()
    assert train.join(test, "id").count() == 0


def test_save_load_identical(spark, trained):
    f, model, _, _ = trained
    path = scratch_path(spark, "t-model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = ml.score(model, f).select("id", F.col("prediction").alias("a"))
    b = ml.score(loaded, f).select("id", F.col("prediction").alias("b"))
    assert a.join(b, "id").filter("a != b").count() == 0


def test_unseen_device_scores(trained):
    f, model, _, _ = trained
    odd = f.limit(5).withColumn("mainDevice", F.lit("never-seen-device"))
    out = ml.score(model, odd).collect()  # V8: no "Unseen label" error
    assert len(out) == 5 and all(r["predictedLabel"] in ("bot", "human") for r in out)


def test_scoring_uses_fitted_labels_and_probability(trained):
    f, model, _, _ = trained
    rows = ml.score(model, f).collect()
    assert len(rows) == f.count()
    assert all(0.5 <= r["probability"] <= 1.0 for r in rows)  # V7: prob. of the predicted class


def test_accuracy_query_agrees_with_evaluator(trained):
    _, model, _, test = trained
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    ev = MulticlassClassificationEvaluator(labelCol="indexedLabel", metricName="accuracy").evaluate(model.transform(test))
    q = ml.evaluate(model, test).first()
    assert abs(ev - q["accuracy"]) < 1e-12 and q["n_test"] == test.count()


def test_grid_dedupes():
    from pyspark.ml.classification import RandomForestClassifier

    assert len(ml.GRID_NUM_TREES) * len(ml.GRID_MAX_DEPTH) == 12
    assert len(ml.param_grid(RandomForestClassifier())) == 9


def test_every_device_keeps_its_category(trained):
    """400 devices are 400 categories: the forest's bins grow with them."""
    f, _, _, _ = trained
    many = f.join(f.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), F.col("id").alias("_i")), F.col("id") == F.col("_i"))
    many = many.withColumn("id", F.col("id") * 4 + F.col("k")).withColumn(
        "mainDevice", F.concat(F.lit("dev-"), (F.col("id") % 400).cast("string"))).drop("k", "_i")
    train, _ = ml.split(many)
    devices = train.select("mainDevice").distinct().count()
    assert devices > ml.MIN_MAX_BINS
    model, _, test = ml.train_forest(many, num_trees=3, max_depth=3)
    assert len(model.stages[0].labels) == devices
    assert ml.score(model, test).count() == test.count()


@pytest.mark.parametrize("fraction", [0.65, 0.75, 0.95, 0.99])
def test_split_fraction_is_met(spark, fraction):
    n = spark.range(100_000).filter(ml.split_flag("id", fraction) == "train").count()
    assert abs(n / 100_000 - fraction) < 0.01


def test_search_keeps_the_best_forest(trained):
    f, _, _, _ = trained
    model, train, test, table = ml.train_best(f, num_trees=(2, 6), max_depth=(1, 3), folds=2)
    best = table.filter("is_best").first()
    assert ml.best_params(model) == (best["numTrees"], best["maxDepth"])
    assert table.count() == 4 and best["avg_accuracy"] == max(r["avg_accuracy"] for r in table.collect())
    assert train.count() + test.count() == f.count()


def test_folds_and_out_of_fold_predictions(trained):
    """Metrics recomputed from the kept out-of-fold predictions equal the
    search's own; folds do not depend on partitioning."""
    import hashlib

    f, _, _, _ = trained
    cvm, table = ml.cross_validate(f, num_trees=(2,), max_depth=(1, 2), folds=3, keep_models=True)
    train, _ = ml.split(f)
    oof = ml.out_of_fold(cvm, train, folds=3)
    rows = oof.collect()
    want = {r["id"]: int(hashlib.md5(f"fold|{r['id']}".encode()).hexdigest()[:8], 16) % 3 for r in train.select("id").collect()}
    assert len(rows) == 2 * len(want) and all(want[r["id"]] == r["fold"] for r in rows)
    for t in table.collect():
        own = [r for r in rows if (r["numTrees"], r["maxDepth"]) == (t["numTrees"], t["maxDepth"])]
        acc = [[r["label"] == r["predictedLabel"] for r in own if r["fold"] == k] for k in range(3)]
        assert abs(sum(sum(a) / len(a) for a in acc) / 3 - t["avg_accuracy"]) < 1e-12
    assert sorted(map(tuple, ml.split(f.repartition(9))[0].select("id", ml.fold("id", 3)).collect())) == sorted(want.items())


def test_stages_before_the_forest_are_fitted_once_per_fold(trained, monkeypatch):
    """A grid of four points fits the vector indexer once for each fold and
    once for the best forest; the averages equal those of Spark's own search."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorIndexer
    from pyspark.ml.tuning import CrossValidator

    f, _, _, _ = trained
    f = ml.materialize(f, "t-features")
    fits, fit = [], VectorIndexer._fit
    monkeypatch.setattr(VectorIndexer, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    cvm, _ = ml.cross_validate(f, num_trees=(2, 5), max_depth=(1, 3), folds=2, materialized=True)
    assert len(fits) == 3
    train = ml.split(f)[0].withColumn("fold", ml.fold("id", 2))
    pipe, rf = ml.forest_pipeline(f, train)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ml.param_grid(rf, (2, 5), (1, 3)), numFolds=2, foldCol="fold",
                        evaluator=MulticlassClassificationEvaluator(labelCol="indexedLabel", metricName="accuracy"))
    want = cv.fit(train)
    assert all(abs(a - b) < 1e-12 for a, b in zip(cvm.avgMetrics, want.avgMetrics))
    assert ml.best_params(cvm.bestModel) == ml.best_params(want.bestModel)
