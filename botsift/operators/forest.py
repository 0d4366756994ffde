"""Decision forests as tables: grown by grouped aggregation, walked by joins.

A forest is a node table (``NODE``), one row per tree and node.  It comes
from two sources: ``grow`` trains it with DataFrame aggregates alone, and
``ml_nodes`` reads it out of a fitted Spark ML forest.  ``walk`` scores any
number of rows against either by one join per level, and ``importances`` is
an aggregate over it.

Growing is level-wise histogram split search.  Feature values are replaced by
the bins of a few cut points per feature; per level, the rows of every open
node are counted by (tree, node, feature, bin, class), combined on the map
side, and the cut with the best Gini gain is taken.  Rows never move: at each
level they are walked down to their node by joins with the level's splits,
which are small tables.  Bootstrap weights and the features that a node may
use are hashes, so a forest does not depend on partitioning or reruns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from botsift.operators import model as ml
from botsift.schemas import MODEL_INPUTS
from botsift.session import materialize, scratch_path

# feature NULL: a leaf; n_categories -1: value <= split[0] goes left, else: a value in split does.
NODE = ("tree int, node bigint, depth int, feature int, n_categories int, split array<double>, "
        "left bigint, right bigint, stats array<double>, n double, gain double")

CLASSES = ("human", "bot")   # order of a grown forest's stats
TREES, DEPTH = 8, 4
BINS = 32                    # cut points per feature, at most
PER_NODE = 4                 # features that a node may split on
MIN_GAIN = 1e-9
UNIT = 1_000_000_000_000     # a tree's vote, as an integer

# Poisson(1) bootstrap: a row counts k times in a tree if its draw, below 2^52, lies between bounds k - 1 and k.
DRAW_BITS = 52
BOOTSTRAP = [math.floor(2**DRAW_BITS * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


@dataclass
class Forest:
    """A node table with what is needed to score feature rows with it."""
    nodes: DataFrame
    classes: tuple[str, ...]
    trees: int
    depth: int
    devices: list[str]

    def score(self, features: DataFrame, keep: list[str] = ()) -> DataFrame:
        """id, predictedLabel, probability (and the columns ``keep``) of
        every feature row; devices that training did not see are kept."""
        votes = walk(self.nodes, vectors(features, self.devices), self.trees, self.depth)
        return features.select("id", *keep).join(decide(votes, self.classes), "id")


def device_code(devices: list[str], col: str = "mainDevice") -> Column:
    """The device's place in ``devices``; others take the place after the last."""
    at = F.array_position(F.array(*[F.lit(d) for d in devices]) if devices else F.array().cast("array<string>"), F.col(col))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(devices))).cast("double")


def vectors(features: DataFrame, devices: list[str], keep: list[str] = ()) -> DataFrame:
    """id, v: the model inputs in vector order, as an array."""
    inputs = [F.col(c).cast("double") if c != "indexedMainDevice" else device_code(devices) for c in MODEL_INPUTS]
    return features.select("id", *keep, F.array(*inputs).alias("v"))


# ------------------------------------------------------------------ growing


def rows_before(counts: DataFrame, group: str, value: str, n: str = "n") -> DataFrame:
    """``counts`` with ``before``: the sum of ``n`` over the smaller values of
    its group.  The order is a distributed sort; a row's sum is that within
    its sorted partition plus the group's in the partitions before, so a
    group may be spread over any number of tasks."""
    s = materialize(counts.orderBy(group, value).withColumn("_part", F.spark_partition_id()), "sorted-values")
    parts = s.groupBy(group, "_part").agg(F.sum(n).alias("_n"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = W.partitionBy(group, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    x = s.withColumn("_own", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(parts, [group, "_part"])
    return x.withColumn("before", F.col("_base") + F.col("_own")).drop("_part", "_base", "_own")


def cut_points(vec: DataFrame, bins: int = BINS) -> list[list[float]]:
    """Per feature, the largest value of each of at most ``bins`` parts with
    about as many rows each.  Equal values are one part.  The driver gets
    these features x bins numbers only."""
    values = vec.select(F.posexplode("v").alias("slot", "value")).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    x = rows_before(values, "slot", "value")
    total = vec.select(F.count(F.lit(1))).scalar()
    part = F.floor(F.col("before") * bins / total)
    edges = x.groupBy("slot", part.alias("part")).agg(F.max("value").alias("edge")).collect()
    n = len(vec.select("v").first()["v"]) if edges else len(MODEL_INPUTS)
    return [sorted(r["edge"] for r in edges if r["slot"] == i) for i in range(n)]


def _draw(*parts: Column | str) -> Column:
    """A number below 2^52 that depends on the values only."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def _binned(vec: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """id, y, bins: per feature, how many cut points lie below the value."""
    one = lambda i: F.size(F.filter(F.array(*[F.lit(float(e)) for e in cuts[i]]), lambda e: e < F.get("v", F.lit(i))))
    return vec.select("id", "y", F.array(*[one(i) for i in range(len(cuts))]).alias("bins"))


def _gini(h, b, n):
    return F.lit(1.0) - (h * h + b * b) / (n * n)


def _best_splits(hist: DataFrame) -> DataFrame:
    """(tree, node) -> slot, bin, gain and the class counts of both sides,
    from the counts h and b per (tree, node, slot, bin).  Of equal gains the
    smallest slot, then bin, wins."""
    by = W.partitionBy("tree", "node", "slot")
    run = by.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = lambda c: F.col(c).cast("double")
    x = hist.select("tree", "node", "slot", "bin", F.sum("h").over(run).alias("lh"), F.sum("b").over(run).alias("lb"),
                    F.sum("h").over(by).alias("h"), F.sum("b").over(by).alias("b"))
    x = x.withColumns({"rh": F.col("h") - F.col("lh"), "rb": F.col("b") - F.col("lb")}).filter("rh + rb > 0")
    n, ln, rn = d("h") + d("b"), d("lh") + d("lb"), d("rh") + d("rb")
    gain = _gini(d("h"), d("b"), n) - (ln * _gini(d("lh"), d("lb"), ln) + rn * _gini(d("rh"), d("rb"), rn)) / n
    x = x.withColumn("gain", gain).filter(F.col("gain") > MIN_GAIN)
    order = F.struct((-F.col("gain")).alias("g"), "slot", "bin")
    best = F.struct("slot", "bin", "gain", "lh", "lb", "rh", "rb")
    return x.groupBy("tree", "node").agg(F.min_by(best, order).alias("s")).select("tree", "node", "s.*")


def grow(features: DataFrame, devices: list[str], trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
         per_node: int = PER_NODE, seed: int = ml.SEED, classes: tuple[str, str] = CLASSES) -> Forest:
    """Train a forest of two classes on the labelled feature rows.

    Rows with another or no label do not count.  Without rows of both classes
    every tree is a leaf; an empty table gives a forest without nodes, whose
    scores are NULL.  A node is split while it has rows of both classes and a
    cut with a gain, to ``depth`` levels.  Tables that go round the levels
    have at most trees x 2^depth rows.
    """
    vec = vectors(features, devices, ["label"]).filter(F.col("label").isin(*classes))
    vec = materialize(vec.withColumn("y", (F.col("label") == classes[1]).cast("int")), "vectors")
    cuts = cut_points(vec, bins)
    rows = _binned(vec, cuts)
    u = _draw(F.lit(str(seed)), F.col("tree").cast("string"), F.col("id").cast("string"))
    w = sum(F.when(u >= F.lit(k), 1).otherwise(0) for k in BOOTSTRAP)
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", w)
    rows = materialize(rows.filter("w > 0").select("tree", F.lit(1).cast("bigint").alias("node"), "y", "w", "bins"), "bootstrap")

    h, b = (F.sum(F.when(F.col("y") == i, F.col("w")).otherwise(0)) for i in (0, 1))
    level = rows.groupBy("tree", "node").agg(h.alias("h"), b.alias("b"))
    done, slots = [], F.array(*[F.lit(i) for i in range(len(cuts))])
    edge = F.array(*[F.array(*[F.lit(float(e)) for e in c]) if c else F.array().cast("array<double>") for c in cuts])
    for d in range(depth + 1):
        level = materialize(level, "level")
        if d == depth:
            splits = level.select("tree", "node").limit(0).selectExpr(
                "tree", "node", "0 slot", "0 bin", "0D gain", "0L lh", "0L lb", "0L rh", "0L rb")
        else:
            rank = F.transform(slots, lambda i: F.struct(F.md5(F.concat_ws(
                "|", F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string"), i.cast("string"))).alias("h"), i.alias("i")))
            may = F.transform(F.slice(F.array_sort(rank), 1, per_node), lambda s: s["i"])
            open_ = level.filter("h > 0 AND b > 0").select("tree", "node", may.alias("slots"))
            x = rows.join(open_, ["tree", "node"]).select("tree", "node", "y", "w", "bins", F.explode("slots").alias("slot"))
            hist = x.groupBy("tree", "node", "slot", F.get("bins", F.col("slot")).alias("bin")).agg(h.alias("h"), b.alias("b"))
            splits = materialize(_best_splits(hist), "splits")
        n = level.join(splits.select("tree", "node", "slot", "bin", "gain"), ["tree", "node"], "left")
        inner = F.col("slot").isNotNull()
        done.append(n.select(
            "tree", "node", F.lit(d).alias("depth"), F.col("slot").cast("int").alias("feature"), F.when(inner, -1).alias("n_categories"),
            F.when(inner, F.array(F.get(F.get(edge, F.col("slot")), F.col("bin")))).alias("split"),
            F.when(inner, F.col("node") * 2).alias("left"), F.when(inner, F.col("node") * 2 + 1).alias("right"),
            F.array(F.col("h").cast("double"), F.col("b").cast("double")).alias("stats"),
            (F.col("h") + F.col("b")).cast("double").alias("n"), "gain"))
        if d < depth:
            side = lambda k, a, c: splits.select("tree", (F.col("node") * 2 + k).alias("node"), F.col(a).alias("h"), F.col(c).alias("b"))
            level = side(0, "lh", "lb").unionByName(side(1, "rh", "rb"))
            down = splits.select("tree", "node", "slot", "bin")
            rows = rows.join(down, ["tree", "node"]).select(
                "tree", (F.col("node") * 2 + (F.get("bins", F.col("slot")) > F.col("bin")).cast("int")).alias("node"), "y", "w", "bins")
    nodes = done[0]
    for x in done[1:]:
        nodes = nodes.unionByName(x)
    return Forest(materialize(nodes, "forest"), classes, trees, depth, devices)


# ------------------------------------------------------------------ scoring


def walk(nodes: DataFrame, vec: DataFrame, trees: int, depth: int) -> DataFrame:
    """id (one row per id), votes: per class the sum over the trees of the class's share in
    the leaf that the row (id, v) ends in, as integers of which UNIT are one
    tree's vote, so the sum does not depend on the order of the trees.

    One join with the node table per level.  It has trees x 2^depth rows at
    most, whatever the input; the planner broadcasts it by its size and the
    rows are not shuffled until their trees' votes meet by id.
    """
    step = nodes.filter("feature IS NOT NULL").select("tree", F.col("node").alias("at"), "feature", "n_categories", "split", "left", "right")
    root = nodes.filter("depth = 0").select("tree", F.col("node").alias("at"))
    x = vec.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).join(root, "tree")
    value = F.get("v", F.col("feature"))
    goes_left = F.when(F.col("n_categories") < 0, value <= F.get("split", F.lit(0))).otherwise(F.array_contains("split", value))
    for _ in range(depth):
        x = x.join(step, ["tree", "at"], "left").select("id", "v", "tree", F.when(
            F.col("feature").isNull(), F.col("at")).when(goes_left, F.col("left")).otherwise(F.col("right")).alias("at"))
    total = F.aggregate("stats", F.lit(0.0), lambda a, s: a + s)
    leaf = nodes.select("tree", F.col("node").alias("at"), F.transform(
        "stats", lambda s: F.floor(s / total * UNIT).cast("bigint")).alias("vote"))
    x = x.join(leaf, ["tree", "at"]).select("id", F.posexplode("vote").alias("class", "vote"))
    x = x.groupBy("id", "class").agg(F.sum("vote").alias("vote"))
    return x.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "vote"))), lambda s: s["vote"]).alias("votes"))


def decide(votes: DataFrame, classes: tuple[str, ...] | list[str]) -> DataFrame:
    """id, predictedLabel, probability (of that label).  Of equal votes the
    first class wins."""
    best = F.array_max("votes")
    total = F.aggregate("votes", F.lit(0).cast("bigint"), lambda a, v: a + v)
    at = F.array_position("votes", best).cast("int") - 1
    return votes.select("id", F.get(F.array(*[F.lit(c) for c in classes]), at).alias("predictedLabel"),
                        (best.cast("double") / total.cast("double")).alias("probability"))


def importances(nodes: DataFrame, names: list[str] = MODEL_INPUTS) -> DataFrame:
    """feature, importance: impurity gain weighted by the node's rows, as
    shares per tree, summed over the trees and scaled to sum 1.  Features
    that no node uses are 0."""
    g = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    per_tree = g.groupBy("tree").agg(F.sum("g").alias("all"))
    shares = g.join(per_tree, "tree").filter(F.col("all") > 0).groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("share"))
    total = shares.select(F.sum("share")).scalar()
    spark = nodes.sparkSession
    every = spark.range(len(names)).select(F.col("id").cast("int").alias("feature"))
    x = every.join(shares, "feature", "left")
    return x.select(F.get(F.array(*[F.lit(c) for c in names]), F.col("feature")).alias("feature"),
                    F.coalesce(F.col("share") / total, F.lit(0.0)).alias("importance"))


# ------------------------------------------------------------------ forests of Spark ML


def ml_nodes(spark: SparkSession, model: PipelineModel, path: str | None = None) -> DataFrame:
    """The node table of a fitted pipeline's forest, from the files that
    Spark ML saves a forest as."""
    forest = ml.forest_of(model)
    path = path or scratch_path(spark, "forest-files")
    forest.write().overwrite().save(path)
    d = spark.read.parquet(f"{path}/data").select(F.col("treeID").cast("int").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    raw = d.select(
        "tree", F.col("id").cast("bigint").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.numCategories")).alias("n_categories"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")).alias("split"),
        F.when(inner, F.col("leftChild").cast("bigint")).alias("left"), F.when(inner, F.col("rightChild").cast("bigint")).alias("right"),
        F.col("impurityStats").alias("stats"), F.aggregate("impurityStats", F.lit(0.0), lambda a, s: a + s).alias("n"),
        F.when(inner, F.col("gain")).alias("gain"))
    # the saved nodes carry no depth: walk down from the roots, one level at a time
    at = raw.filter("node = 0").select("tree", "node").withColumn("depth", F.lit(0))
    levels = [at]
    for i in range(max(t.depth for t in forest.trees)):
        p = raw.join(levels[-1].drop("depth"), ["tree", "node"]).filter("left IS NOT NULL")
        levels.append(p.select("tree", F.explode(F.array("left", "right")).alias("node")).withColumn("depth", F.lit(i + 1)))
    depths = levels[0]
    for x in levels[1:]:
        depths = depths.unionByName(x)
    cols = [c.split()[0] for c in NODE.split(", ")]
    return materialize(raw.join(depths, ["tree", "node"]).select(*cols), "ml-forest")


def ml_walk(model: PipelineModel, features: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, predictedLabel, probability of a fitted Spark ML pipeline, by
    walking its forest's node table."""
    forest = ml.forest_of(model)
    nodes = nodes if nodes is not None else ml_nodes(features.sparkSession, model)
    rows = features.drop("label")
    for stage in model.stages[:model.stages.index(forest)]:
        # the label indexer has nothing to do here
        if stage.hasParam("inputCol") and stage.isDefined("inputCol") and stage.getInputCol() == "label":
            continue
        rows = stage.transform(rows)
    vec = rows.select("id", vector_to_array(forest.getFeaturesCol()).alias("v"))
    trees = forest.trees
    votes = walk(nodes, vec, len(trees), max(t.depth for t in trees))
    return decide(votes, next(s for s in model.stages if s.hasParam("labels") and s.uid.startswith("IndexToString")).getLabels())
