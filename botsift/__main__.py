"""Command line: the reference's three entry points as batch jobs.

  python -m botsift train  --labelled L --users U --statuses S [--label-events E] --model M
  python -m botsift classify --model M --ids I --users U --statuses S [--stored F] --out O
  python -m botsift score  --model M --features F --out O
  python -m botsift label  --events-in DIR --table T --checkpoint C

Inputs are Parquet tables with the schemas in ``botsift.schemas`` (users,
statuses as produced by ``botsift.sources.fixtures``); the labelled file is
text.  ``spark-submit -m``-style use works the same way: the session comes
from the environment (cluster settings, spark.checkpoint.dir).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    from botsift.session import ensure_checkpoint_dir

    spark = SparkSession.builder.appName("botsift").getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="botsift")
    sub = ap.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--labelled", required=True)
    t.add_argument("--users", required=True)
    t.add_argument("--statuses", required=True)
    t.add_argument("--label-events")
    t.add_argument("--model", required=True)
    t.add_argument("--features-out")
    t.add_argument("--timeline", type=int, help="only the N newest posts of an account")
    t.add_argument("--trees", type=int, nargs="+", help="forest sizes to search (one: no search)")
    t.add_argument("--depth", type=int, nargs="+", help="tree depths to search (one: no search)")
    t.add_argument("--folds", type=int, default=4)
    s = sub.add_parser("score")
    s.add_argument("--model", required=True)
    s.add_argument("--features", required=True)
    s.add_argument("--out", required=True)
    c = sub.add_parser("classify")
    for arg in ("--model", "--ids", "--users", "--statuses", "--out"):
        c.add_argument(arg, required=True)
    c.add_argument("--stored")
    lab = sub.add_parser("label")
    lab.add_argument("--events-in", required=True)
    lab.add_argument("--table", required=True)
    lab.add_argument("--checkpoint", required=True)
    a = ap.parse_args(argv)

    spark = _session()
    if a.cmd == "train":
        from botsift.operators.model import best_params
        from botsift.plans.training import build_models

        ev = spark.read.parquet(a.label_events) if a.label_events else None
        one = lambda x: None if not x else x[0] if len(x) == 1 else tuple(x)
        forest = {k: v for k, v in (("num_trees", one(a.trees)), ("max_depth", one(a.depth))) if v}
        run = build_models(spark, a.labelled, spark.read.parquet(a.users), spark.read.parquet(a.statuses),
                           label_events=ev, model_path=a.model, n=a.timeline, folds=a.folds, **forest)
        if a.features_out:
            run.features.write.mode("overwrite").parquet(a.features_out)
        trees, depth = best_params(run.model)
        print(f"forest: {trees} trees, depth {depth}")
        run.evaluation.show()
    elif a.cmd == "classify":
        from pyspark.ml import PipelineModel

        from botsift.operators.classify import classify

        stored = spark.read.parquet(a.stored) if a.stored else None
        classify(PipelineModel.load(a.model), spark.read.parquet(a.ids), spark.read.parquet(a.users),
                 spark.read.parquet(a.statuses), stored).write.mode("overwrite").parquet(a.out)
    elif a.cmd == "score":
        from pyspark.ml import PipelineModel

        from botsift.operators.model import score

        score(PipelineModel.load(a.model), spark.read.parquet(a.features)) \
            .write.mode("overwrite").parquet(a.out)
    elif a.cmd == "label":
        from botsift.streaming.labels import start_label_upsert

        start_label_upsert(spark, a.events_in, a.table, a.checkpoint, available_now=True).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
