"""Measure per-task shuffle input of the flagship under a hot account.

A third of all posts are reassigned to one account, the input is spread
over 16 splits (as many files would be), and user_features runs with the
event log on.  Reports, per shuffle-reading stage, the max and median
records read by one task.  Usage:
    python tools/skew_probe.py SF_DIR EVENT_LOG_DIR
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from botsift.operators import features as fx  # noqa: E402
from botsift.session import local_session  # noqa: E402
from botsift.sources import fixtures as fix  # noqa: E402


def main():
    sf_dir, log_dir = sys.argv[1], sys.argv[2]
    spark = local_session(8, **{"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false",
                                "spark.ui.showConsoleProgress": "false",
                                "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    users = fix.users(spark, sf_dir)
    st = fix.statuses(spark, sf_dir).repartition(16)
    hot = st.withColumn("user_id", F.when(F.col("status_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")))
    for label, n in (("timeline N=250", 250), ("all posts (n=None)", None)):
        spark.sparkContext.setJobDescription(label)
        fx.user_features(users, hot, n=n).write.format("noop").mode("overwrite").save()
    total = hot.count()
    spark.stop()
    stages: dict[tuple[str, int], list[int]] = {}
    desc: dict[int, str] = {}
    for path in [p for p in glob.glob(f"{log_dir}/**", recursive=True) if os.path.isfile(p)]:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev["Event"] == "SparkListenerJobStart":
                    d = ev.get("Properties", {}).get("spark.job.description", "")
                    for s in ev.get("Stage IDs", []):
                        desc[s] = d
                if ev["Event"] == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    if r:
                        stages.setdefault(ev["Stage ID"], []).append(r)
    print(f"posts: {total}, hot account: {total // 3} (one third)")
    for sid in sorted(stages):
        rs = stages[sid]
        print(f"{desc.get(sid, ''):22s} stage {sid:3d}: tasks {len(rs):3d}  max records/task {max(rs):7d}"
              f"  median {int(statistics.median(rs)):7d}  total {sum(rs):8d}")


if __name__ == "__main__":
    main()
