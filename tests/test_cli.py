"""Command-line entry points, run in-process on fixture tables."""

from botsift.__main__ import main
from botsift.session import scratch_path
from botsift.sources import fixtures as fix
from botsift.sources import labelled as lb


def test_train_score_label(spark, sf_small):
    root = scratch_path(spark, "t-cli")
    fix.users(spark, sf_small).write.parquet(f"{root}/users")
    fix.statuses(spark, sf_small).write.parquet(f"{root}/statuses")
    fix.label_events(spark, sf_small).write.parquet(f"{root}/events")
    lb.write_lines(fix.labelled_lines(spark, sf_small), f"{root}/labelled")
    assert main(["train", "--labelled", f"{root}/labelled", "--users", f"{root}/users",
                 "--statuses", f"{root}/statuses", "--label-events", f"{root}/events",
                 "--model", f"{root}/model", "--features-out", f"{root}/features",
                 "--trees", "2", "4", "--depth", "3", "--folds", "2"]) == 0
    assert main(["score", "--model", f"{root}/model", "--features", f"{root}/features",
                 "--out", f"{root}/scores"]) == 0
    scores = spark.read.parquet(f"{root}/scores")
    assert scores.count() == spark.read.parquet(f"{root}/features").count()
    fix.lookup_requests(spark, sf_small).write.parquet(f"{root}/ids")
    assert main(["classify", "--model", f"{root}/model", "--ids", f"{root}/ids", "--users", f"{root}/users",
                 "--statuses", f"{root}/statuses", "--stored", f"{root}/features", "--out", f"{root}/classified"]) == 0
    out = spark.read.parquet(f"{root}/classified")
    assert out.count() == spark.read.parquet(f"{root}/ids").distinct().count()
    assert {r["state"] for r in out.select("state").distinct().collect()} == {"stored", "computed", "missing"}
    assert main(["label", "--events-in", f"{root}/events", "--table", f"{root}/labels",
                 "--checkpoint", f"{root}/ck"]) == 0
    assert spark.read.parquet(f"{root}/labels").count() > 0
