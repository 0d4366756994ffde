"""Streaming label upsert: result equals the batch last-wins; replays are
idempotent and late files are folded in."""

from pyspark.sql import functions as F

from botsift.operators.dedupe import last_wins
from botsift.session import scratch_path
from botsift.sources import fixtures as fix
from botsift.streaming import labels as sl


def test_stream_equals_batch(spark, sf_small):
    ev = fix.label_events(spark, sf_small)
    got = sl.run_once(spark, ev, scratch_path(spark, "t-stream"))
    want = last_wins(ev, "user_id", "seq").select("user_id", "seq", "label")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_file_and_restart(spark, sf_small):
    root = scratch_path(spark, "t-stream2")
    src, table, ckpt = f"{root}/in", f"{root}/labels", f"{root}/ck"
    ev = fix.label_events(spark, sf_small)
    first = ev.filter(F.col("seq") % 2 == 0)
    sl.write_event_files(first, f"{src}/a")
    sl.start_label_upsert(spark, f"{src}/*", table, ckpt).awaitTermination()
    # restart from the same checkpoint with a new file: only it is processed
    sl.write_event_files(ev.filter(F.col("seq") % 2 == 1), f"{src}/b")
    sl.start_label_upsert(spark, f"{src}/*", table, ckpt).awaitTermination()
    got = sl.read_labels(spark, table)
    want = last_wins(ev, "user_id", "seq").select("user_id", "seq", "label")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_scoring_equals_batch(spark):
    from botsift.operators import features as fx
    from botsift.operators import model as ml
    from botsift.streaming import scoring

    sf = "/root/testdata/sf0.01"
    f = fx.user_features(fix.users(spark, sf), fix.statuses(spark, sf))
    model, _, _ = ml.train_forest(f, num_trees=5, max_depth=3)
    path = scratch_path(spark, "t-stream-model")
    model.write().overwrite().save(path)
    streamed = scoring.run_once(spark, path, f, scratch_path(spark, "t-stream-score"))
    batch = ml.score(model, f)
    cols = ["id", "predictedLabel", "probability"]
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0


def test_compaction_then_more_batches(spark, sf_small):
    root = scratch_path(spark, "t-compact")
    src, table, ckpt = f"{root}/in", f"{root}/labels", f"{root}/ck"
    ev = fix.label_events(spark, sf_small)
    sl.write_event_files(ev.filter(F.col("seq") % 3 == 0), f"{src}/a")
    sl.start_label_upsert(spark, f"{src}/*", table, ckpt, max_files_per_trigger=1).awaitTermination()
    upto = sl.compact(spark, table)
    from botsift.sources.snapshots import latest_snapshot

    assert latest_snapshot(spark, table) == upto
    sl.write_event_files(ev.filter(F.col("seq") % 3 != 0), f"{src}/b")
    sl.start_label_upsert(spark, f"{src}/*", table, ckpt, max_files_per_trigger=1).awaitTermination()
    got = sl.read_labels(spark, table)
    want = last_wins(ev, "user_id", "seq").select("user_id", "seq", "label")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_two_checkpoints_share_a_table(spark, sf_small):
    """A stream with a new checkpoint counts its batches from 0 again; it
    must not replace the first one's, nor be taken for older than a snapshot."""
    root = scratch_path(spark, "t-two")
    ev = fix.label_events(spark, sf_small)
    sl.run_once(spark, ev.filter("seq % 3 = 0"), root, source="a")
    sl.run_once(spark, ev.filter("seq % 3 = 1"), root, source="b")
    sl.compact(spark, f"{root}/labels")
    got = sl.run_once(spark, ev.filter("seq % 3 = 2"), root, source="c")
    want = last_wins(ev, "user_id", "seq").select("user_id", "seq", "label")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert sl.compact(spark, f"{root}/labels") == 2
    again = sl.read_labels(spark, f"{root}/labels")
    assert again.exceptAll(want).count() == 0 and want.exceptAll(again).count() == 0
