"""Distributed connected components by alternating star contraction.

Only joins, aggregates and written tables: no node, link or component is
collected to the driver.  Each round is a large-star step (every larger
neighbour of a node is linked to the smallest one) followed by a small-star
step (the same for the smaller neighbours); both keep components intact and
the number of rounds grows with the logarithm of a component's size.  The
per-node minimum is an aggregate with map-side combine and goes back to the
links by a join that Spark can split when a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.session import materialize


def _star(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u > v)."""
    both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        links.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    kept = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _fingerprint(links: DataFrame):
    return links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another node;
    ``component`` is the smallest node reachable.

    Links are undirected pairs of longs in any order, repeated or not;
    loops and links with a NULL end are ignored, so nodes without any other
    link are absent.  No links give an empty table.
    """
    cur = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).distinct()
    cur = materialize(cur, "links")
    before = _fingerprint(cur)
    while before["n"]:
        cur = materialize(_star(cur), "links")
        after = _fingerprint(cur)
        if after == before:
            break
        before = after
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
