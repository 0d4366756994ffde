"""From hash buckets to components of verified links.

Buckets hold candidates: rows (key, node, n), n the size of the node's set.
All pairs of a bucket are never emitted.  First every node is verified
against a few centres of its bucket, so the pairs grow with the rows of a
bucket; their links give components.  Only pairs of a bucket that are still
in different components matter then.  Most of their nodes are ruled out by a
bound that needs no pairs: a node can only be linked to another component if
enough of its elements occur in other components at all.  The nodes that are
left are compared in blocks, so every link that could join two components is
found, and no pair is emitted that is not a link.

Blocks compare whole families of overlapping buckets, which grow with their
square, and are copied as often as they meet others.  ``paired`` asks for the
pairs of a bucket only; with ``sketches`` no set is copied for them either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.components import connected_components
from botsift.session import materialize

PRUNE_ROUNDS = 2  # the bound tightens as nodes go; any number of rounds is exact
BLOCK = 8192      # elements of the sets that are compared at once
PART = 16384      # nodes of a bucket whose sketches are compared in one task
WORDS = 16        # longs of a sketch
# A bucket's centres are its smallest nodes in these orders: ids with some bits flipped.
ORDERS = (0, 0x2AAAAAAAAAAAAAAA, 0x0F0F69C3A5964B2D, 0x35C9D2B87E14C699)


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """The rows (key, node, n) of buckets with two nodes or more, with the
    bucket's centres; written to the shared folder."""
    many = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    rows = materialize(keyed.join(many.select("key"), "key"), "bucket-rows")  # few, as most buckets have one node
    centre = lambda x: F.min(F.col("node").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x))
    centres = rows.groupBy("key").agg(F.array(*[centre(x) for x in ORDERS]).alias("centres"))
    return materialize(rows.join(centres, "key"), "buckets")


def _prune(open_: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The rows (key, node, n, c) whose node may be linked to another
    component; u counts the node's elements that other components have.

    A link of sets x and y needs (100 + percent) * |x and y| >= percent *
    (|x| + |y|); |x and y| is at most u, and |y| is at least the smallest
    size in x's buckets and at least percent of |x|.
    """
    small = open_.groupBy("key").agg(F.min("n").alias("least"))
    nodes = open_.join(small, "key").groupBy("node", "n", "c").agg(F.min("least").alias("least"))
    el = elements.join(nodes.select("node", "c"), "node")
    both = el.groupBy("e").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("e")
    u = el.join(both, "e").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    may = nodes.join(u, "node").filter(
        (100 + percent) * F.col("u") * 100 >= percent * (100 * F.col("n") + F.greatest(100 * F.col("least"), percent * F.col("n"))))
    left = open_.join(may.select("node"), "node")
    split = left.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("key")
    return materialize(left.join(split, "key"), "open-buckets")


def _blocks(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of each family in blocks of about BLOCK elements: (f, big, bid,
    members).  A component larger than a block gets blocks of its own
    (``big`` is its name); small ones share blocks, each whole in one."""
    sizes = nodes.groupBy("f", "c").agg(F.sum("n").alias("size"))
    small = sizes.filter(F.col("size") <= BLOCK).groupBy("f").agg(F.sum("size").alias("all"))
    x = nodes.join(sizes, ["f", "c"]).join(small, "f", "left")
    own = F.col("size") > BLOCK
    part = F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))).otherwise(
        F.pmod(F.xxhash64("c"), F.ceil(F.col("all") / BLOCK)))
    x = x.select("f", F.when(own, F.col("c")).alias("big"), part.alias("part"), "node", "n", "c").join(sets, "node")
    b = x.groupBy("f", "big", "part").agg(F.collect_list(F.struct("node", "n", "c", "s")).alias("members"))
    return b.select("f", "big", F.xxhash64("f", "big", "part").alias("bid"), "members")


def _across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, among nodes whose buckets connect them
    (a family).  Blocks of a family are compared with each other; two blocks
    of one component are not.  No pair is a row: a row is two blocks, and
    only true links leave it."""
    low = left.groupBy("key").agg(F.min("node").alias("b"))
    family = connected_components(left.select("key", F.col("node").alias("a")).join(low, "key").select("a", "b").distinct())
    nodes = left.select("node", "n", "c").distinct().join(family.withColumnRenamed("component", "f"), "node")
    blocks = materialize(_blocks(nodes, sets), "blocks")
    ids = blocks.select("f", "big", "bid")
    meet = ids.alias("x").join(ids.alias("y"), "f").filter("x.bid <= y.bid AND NOT coalesce(x.big = y.big, false)").select(
        F.col("x.bid").alias("xb"), F.col("y.bid").alias("yb"))
    side = lambda i, m: blocks.select(F.col("bid").alias(i), F.col("members").alias(m))
    rows = meet.join(side("xb", "xs"), "xb").join(side("yb", "ys"), "yb")

    def linked(x, y):
        other = (x["c"] != y["c"]) & ((F.col("xb") != F.col("yb")) | (x["node"] < y["node"]))
        near = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
        return other & near & ((100 + percent) * F.size(F.array_intersect(x["s"], y["s"])) >= percent * (x["n"] + y["n"]))

    found = F.flatten(F.transform("xs", lambda x: F.transform(
        F.filter("ys", lambda y: linked(x, y)),
        lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))))
    return rows.select(F.explode(found).alias("l")).select("l.a", "l.b")


def _pairs(left: DataFrame, near: str) -> DataFrame:
    """The pairs (a, b) of a bucket that are in different components and
    near in size, once however many buckets they share."""
    x, y = (left.select("key", F.col("node").alias(i), F.col("n").alias("n" + i), F.col("c").alias("c" + i)) for i in "ab")
    return x.join(y, "key").filter(f"a < b AND ca <> cb AND {near}").select("a", "b").distinct()


def sketched(elements: DataFrame) -> DataFrame:
    """Per node of the rows (node, e): a bitmap of 64 * WORDS bits, as longs
    w0, w1, ..., of the elements' low bits."""
    at = F.col("e").bitwiseAND(F.lit(64 * WORDS - 1)).cast("int")
    bit = F.expr("shiftleft(1L, at & 63)")
    return elements.select("node", at.alias("at")).groupBy("node").agg(
        *[F.bit_or(F.when(F.shiftright("at", 6) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}") for i in range(WORDS)])


def _close_pairs(left: DataFrame, sketches: DataFrame, near: str, percent: int) -> DataFrame:
    """Those of ``_pairs`` that may be linked by their sketches, for buckets
    of any size.

    Sets that differ in d elements have sketches that differ in d bits at
    most, and a link of sets x and y needs (100 + percent) * d <=
    (100 - percent) * (|x| + |y|).  The join compares the sketches, so other
    pairs are no rows.  Buckets of more than PART nodes are dealt in parts,
    each of which meets each.
    """
    parts = F.ceil(F.col("open") / PART).cast("int")
    x = left.join(sketches, "node").withColumns({"part": F.pmod(F.xxhash64("node"), parts).cast("int"), "parts": parts})
    x = x.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    words = [f"w{i}" for i in range(WORDS)]
    side = lambda i, p, q: x.select(
        "key", F.col(p).alias("p"), F.col(q).alias("q"), *[F.col(c).alias(k + i) for c, k in (("node", ""), ("n", "n"), ("c", "c"))],
        *[F.col(w).alias(w + i) for w in words])
    bits = " + ".join(f"bit_count({w}a ^ {w}b)" for w in words)
    close = f"{100 + int(percent)} * ({bits}) <= {100 - int(percent)} * (na + nb)"
    pairs = side("a", "part", "other").join(side("b", "other", "part"), ["key", "p", "q"])
    return pairs.filter(f"a < b AND ca <> cb AND {near} AND {close}").select("a", "b").distinct()


def bucket_links(buckets: DataFrame, sizes: DataFrame, sets: Callable[[DataFrame], DataFrame],
                 verify: Callable[[DataFrame], DataFrame], percent: int, paired: int = 0,
                 sketches: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) that join all nodes of one component.

    With ``paired``, only pairs of a bucket are compared: nodes that are no
    centre of it, since all others have met their centre.  Up to ``paired``
    of them in a bucket, their pairs are rows, at most paired / 2 a node;
    the others are compared in blocks.  With ``sketches`` too, which gives
    the nodes' ``sketched`` sets, pairs that these rule out are no rows, and
    no bucket needs blocks.

    ``sizes`` has (node, n); ``sets(nodes)`` gives (node, s), the distinct
    elements of the nodes' sets as longs; ``verify`` keeps the pairs (a, b)
    that are truly linked.
    """
    near = f"100 * least(na, nb) >= {int(percent)} * greatest(na, nb)"  # sets of too different sizes cannot link
    star = buckets.select("node", "n", F.explode(F.array_distinct("centres")).alias("centre")).filter("node <> centre").distinct()
    star = star.select(F.col("centre").alias("c"), F.col("node").alias("d"), F.col("n").alias("nb"))
    star = star.join(sizes.select(F.col("node").alias("c"), F.col("n").alias("na")), "c").filter(near)
    links = materialize(verify(star.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()), "star-links")

    comp = connected_components(links)
    if paired:
        buckets = buckets.filter(~F.array_contains("centres", F.col("node")))
    placed = buckets.drop("centres").join(comp, "node", "left").select(
        "key", "node", "n", F.coalesce("component", "node").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("open")).filter("c0 < c1")
    left = materialize(placed.join(split.select("key", "open"), "key"), "open-buckets")
    if paired and sketches:
        maps = materialize(sketches(left.select("node").distinct()), "sketches")
        return links.unionByName(verify(materialize(_close_pairs(left, maps, near, percent), "close-pairs")))
    if paired:
        links = materialize(links.unionByName(verify(_pairs(left.filter(F.col("open") <= paired), near))), "pair-links")
        left = left.filter(F.col("open") > paired)
    left = left.drop("open")
    own = materialize(sets(left.select("node").distinct()), "open-sets")
    elements = own.select("node", F.explode("s").alias("e"))
    for _ in range(PRUNE_ROUNDS):
        left = _prune(left, elements, percent)
    return links.unionByName(verify(_across(left, own, percent)))
