"""Label feedback: corrections arrive as an append-only event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.operators.resolve import current_labels
from botsift.sources import profile_store as ps


def label_upsert(store: DataFrame, label_events: DataFrame) -> DataFrame:
    """Apply label corrections to stored profiles.

    A correction overwrites the stored label; a correction for an account
    with no stored profile creates one.  Returns user_id, label, origin in
    {updated, created, unchanged}.
    """
    cur = current_labels(label_events).select("user_id", F.col("label").alias("_new"))
    st = store.filter(F.col("state") == "found").select("user_id", F.col("label").alias("_old"),
                                                        F.lit(True).alias("_stored"))
    j = st.join(cur, "user_id", "full_outer")
    return j.select(
        "user_id",
        F.coalesce("_new", "_old").alias("label"),
        F.when(F.col("_stored").isNull(), F.lit("created"))
        .when(F.col("_new").isNotNull(), F.lit("updated"))
        .otherwise(F.lit("unchanged")).alias("origin"),
    )


def store_corrections(upserted: DataFrame, users: DataFrame) -> DataFrame:
    """Store rows (see ``profile_store.write_version``) for the corrected ids
    of ``label_upsert``: accounts are fetched with their profile and carry
    the corrected label, ids that are no account become tombstones."""
    changed = upserted.filter(F.col("origin") != "unchanged").select("user_id", F.col("label").alias("_new"))
    rows = ps.resolve(changed, users).join(changed, "user_id")
    return rows.select("user_id", "state", F.when(F.col("state") == ps.FOUND, F.col("_new")).alias("label"), "profile_json")
