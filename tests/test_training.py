"""End-to-end training run on fixture data."""

from pyspark.sql import functions as F

from botsift.plans.training import build_models
from botsift.session import scratch_path
from botsift.sources import fixtures as fix
from botsift.sources import labelled as lb


def test_build_models_end_to_end(spark):
    sf = "/root/testdata/sf0.01"
    path = lb.write_lines(fix.labelled_lines(spark, sf), scratch_path(spark, "t-lab"))
    run = build_models(spark, path, fix.users(spark, sf), fix.statuses(spark, sf),
                       label_events=fix.label_events(spark, sf), num_trees=(2, 5), max_depth=(3,), folds=2)
    repeated = fix.users(spark, sf).filter("user_id % 10 = 1").join(fix.statuses(spark, sf), "user_id", "left_semi").count()
    n_lines = spark.read.text(path).count() - repeated  # earlier lines of the same accounts
    assert run.features.count() + run.quarantine.count() + run.tombstones.count() == n_lines
    # corrections override the file label (C11/H2): every account has an order -> override
    assert run.features.filter(F.col("label_source") != "override").count() == 0
    acc = run.evaluation.collect()[0]
    assert 0.0 <= acc["accuracy"] <= 1.0 and acc["n_test"] > 0
