"""Spam-link path: URLs of labelled posts matched against a threat list.

The reference sends each class's URL set to a web service; here the URL set
is one DataFrame joined to a threat table.  Per (class, URL) the post kept is
the last one in input order (largest status_id), as the reference's map.put.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.functions.columns import canonical_url, label_to_double

# Threat filter of the reference request (fixed values).
THREAT_TYPES = ("MALWARE", "SOCIAL_ENGINEERING")
PLATFORM_TYPES = ("WINDOWS",)
THREAT_ENTRY_TYPES = ("URL",)


def status_urls(posts: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per (post, URL entity): status_id, label, url[, text].

    The canonical URL is the expanded one when present (the reference keys
    humans by short and bots by expanded URL; we use one rule for both)."""
    keep = ["status_id", "label"] + (["text"] if with_text else [])
    e = posts.select(*keep, F.explode("urls").alias("e"))
    return e.select(*keep, canonical_url("e").alias("url")).filter(F.col("url").isNotNull())


def flagged(threats: DataFrame) -> DataFrame:
    return threats.filter(
        F.col("threat_type").isin(*THREAT_TYPES)
        & F.col("platform_type").isin(*PLATFORM_TYPES)
        & F.col("threat_entry_type").isin(*THREAT_ENTRY_TYPES)
    )


def spam_urls(urls: DataFrame, threats: DataFrame) -> DataFrame:
    """Distinct URLs that appear on the threat list, with the threat type."""
    t = flagged(threats).select("url", "threat_type").distinct()
    return urls.select("url").distinct().join(t, "url", "inner")


def labelled_statuses(posts: DataFrame, threats: DataFrame) -> DataFrame:
    """Training rows for the text model: for each class and each flagged
    URL, the text of the last post carrying it; label 0.0 human, 1.0 bot.

    The per-(class, URL) winner is found on ids only (a partial max); texts
    are attached at the end for the winners only, by a join on their ids
    (with few winners AQE broadcasts them and no text is shuffled).
    """
    u = status_urls(posts, with_text=False)
    last = u.groupBy("label", "url").agg(F.max("status_id").alias("status_id"))
    t = flagged(threats).select("url").distinct()
    hit = last.join(t, "url", "left_semi")
    texts = posts.select("status_id", F.col("text").alias("statusText"))
    out = texts.join(hit, "status_id", "inner")
    return out.select(label_to_double("label").alias("label"), "url", "status_id", "statusText")


def spam_counts(posts: DataFrame, threats: DataFrame) -> DataFrame:
    """Per class: posts, distinct URLs, distinct flagged URLs."""
    u = status_urls(posts, with_text=False)
    t = flagged(threats).select("url").distinct().withColumn("_hit", F.lit(True))
    j = u.join(t, "url", "left")
    return j.groupBy("label").agg(
        F.countDistinct("status_id").alias("n_statuses"),
        F.countDistinct("url").alias("n_urls"),
        F.countDistinct(F.when(F.col("_hit"), F.col("url"))).alias("n_spam_urls"),
    )
