"""Forests as tables: split search against brute force, the walk against
Spark ML's own transform, importances against Spark ML's vector."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from botsift.operators import features as fx
from botsift.operators import forest as fr
from botsift.operators import model as ml
from botsift.schemas import FEATURES, MODEL_INPUTS
from botsift.sources import fixtures as fix

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def feats(spark):
    return fx.user_features(fix.users(spark, SF), fix.statuses(spark, SF)).cache()


@pytest.fixture(scope="module")
def ml_forest(spark, feats):
    model, train, test = ml.train_forest(feats, num_trees=7, max_depth=4)
    return model, fr.ml_nodes(spark, model)


def test_walk_equals_spark_ml_on_every_account_and_unseen_devices(spark, feats, ml_forest):
    model, nodes = ml_forest
    odd = feats.withColumn("mainDevice", F.concat(F.lit("unseen-"), F.col("id") % 3)).withColumn("id", -1 - F.col("id"))
    rows = feats.unionByName(odd)
    a = {r["id"]: r for r in ml.score(model, rows).collect()}
    b = {r["id"]: r for r in fr.ml_walk(model, rows, nodes).collect()}
    assert a.keys() == b.keys() and len(a) == 2 * feats.count()
    for i, r in a.items():
        assert r["predictedLabel"] == b[i]["predictedLabel"]
        assert abs(r["probability"] - b[i]["probability"]) < 1e-9


def test_node_table_matches_the_debug_string(ml_forest):
    model, nodes = ml_forest
    forest = ml.forest_of(model)
    assert nodes.count() == sum(t.numNodes for t in forest.trees)
    text = forest.toDebugString
    assert nodes.filter("feature IS NOT NULL").count() == text.count("If (feature ") == text.count("Else (feature ")
    assert nodes.agg(F.max("depth")).first()[0] == max(t.depth for t in forest.trees)


def test_importances_equal_spark_ml(ml_forest):
    model, nodes = ml_forest
    got = {r["feature"]: r["importance"] for r in fr.importances(nodes).collect()}
    want = ml.forest_of(model).featureImportances.toArray()
    assert list(got) and set(got) == set(MODEL_INPUTS)
    assert all(abs(got[n] - w) < 1e-9 for n, w in zip(MODEL_INPUTS, want))


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def brute_forest(rows, devices, trees, depth, bins, per_node, seed):
    """Nodes by plain loops: (tree, node) -> (feature, threshold, stats, gain)."""
    vec = {}
    for r in rows:
        v = [float(devices.index(r["mainDevice"]) if r["mainDevice"] in devices else len(devices)) if c == "indexedMainDevice"
             else float(r[c]) for c in MODEL_INPUTS]
        vec[r["id"]] = (v, fr.CLASSES.index(r["label"]))
    cuts = []
    for s in range(len(MODEL_INPUTS)):
        values = sorted(v[s] for v, _ in vec.values())
        parts = {}
        for x in values:
            parts[values.index(x) * bins // len(values)] = max(x, parts.get(values.index(x) * bins // len(values), x))
        cuts.append(sorted(parts.values()))
    nodes = {}

    def gini(h, b):
        return 1.0 - (float(h) * h + float(b) * b) / (float(h + b) * (h + b))

    def split(tree, node, own, d):
        h, b = (sum(w for i, w in own if vec[i][1] == y) for y in (0, 1))
        nodes[tree, node] = (None, None, [h, b], None)
        if d == depth or not h or not b:
            return
        slots = sorted(range(len(cuts)), key=lambda s: hashlib.md5(f"{seed}|{tree}|{node}|{s}".encode()).hexdigest())[:per_node]
        best = None
        for s in sorted(slots):
            for c in cuts[s]:
                left = [(i, w) for i, w in own if vec[i][0][s] <= c]
                lh, lb = (sum(w for i, w in left if vec[i][1] == y) for y in (0, 1))
                rh, rb = h - lh, b - lb
                if not lh + lb or not rh + rb:
                    continue
                gain = gini(h, b) - (float(lh + lb) * gini(lh, lb) + float(rh + rb) * gini(rh, rb)) / float(h + b)
                if gain > fr.MIN_GAIN and (best is None or gain > best[0]):
                    best = (gain, s, c, left)
        if best:
            gain, s, c, left = best
            nodes[tree, node] = (s, c, [h, b], gain)
            kept = {i for i, _ in left}
            split(tree, 2 * node, left, d + 1)
            split(tree, 2 * node + 1, [x for x in own if x[0] not in kept], d + 1)

    for t in range(trees):
        own = [(i, sum(draw(seed, t, i) >= k for k in fr.BOOTSTRAP)) for i in vec]
        split(t, 1, [x for x in own if x[1]], 0)
    return nodes


def test_grown_forest_equals_brute_force(spark, feats):
    rows = [r.asDict() for r in feats.orderBy("id").limit(160).collect()]
    devices = ["click", "view"]
    df = spark.createDataFrame([tuple(r[c] for c in FEATURES.fieldNames()) for r in rows], FEATURES)
    f = fr.grow(df.repartition(5), devices, trees=3, depth=3, bins=8, per_node=5, seed=11)
    got = {(r["tree"], r["node"]): r for r in f.nodes.collect()}
    want = brute_forest(rows, devices, 3, 3, 8, 5, 11)
    assert got.keys() == want.keys()
    for k, (s, c, stats, gain) in want.items():
        r = got[k]
        assert r["stats"] == stats and r["feature"] == s
        if s is not None:
            assert r["split"] == [c] and abs(r["gain"] - gain) < 1e-12
    # scores: walk the brute-force nodes row by row
    scores = {r["id"]: r for r in f.score(df).collect()}
    assert scores.keys() == {r["id"] for r in rows}
    for r in rows:
        votes = [0, 0]
        for t in range(3):
            node = 1
            while want[t, node][0] is not None:
                s, c = want[t, node][:2]
                x = float(devices.index(r["mainDevice"]) if r["mainDevice"] in devices else 2) if s == 12 else float(r[MODEL_INPUTS[s]])
                node = 2 * node + (x > c)
            st = want[t, node][2]
            votes = [v + int(x / sum(st) * fr.UNIT) for v, x in zip(votes, st)]
        assert scores[r["id"]]["predictedLabel"] == fr.CLASSES[votes.index(max(votes))]
        assert abs(scores[r["id"]]["probability"] - max(votes) / sum(votes)) < 1e-12


def test_cut_points_of_skewed_and_tied_values(spark):
    rng = random.Random(3)
    rows = [(i, [0.0 if i % 3 else float(i), float(rng.randint(0, 5)), float(rng.random())]) for i in range(900)]
    cuts = fr.cut_points(spark.createDataFrame(rows, "id bigint, v array<double>").repartition(7), bins=8)
    for s, c in enumerate(cuts):
        values = sorted(v[s] for _, v in rows)
        want = {}
        for x in values:
            p = values.index(x) * 8 // 900
            want[p] = max(want.get(p, x), x)
        assert c == sorted(want.values())


def test_degenerate_training_sets(spark, feats):
    none = fr.grow(feats.limit(0), ["click"], trees=2, depth=2)
    assert none.nodes.count() == 0 and none.score(feats.limit(5)).count() == 0
    one = fr.grow(feats.withColumn("label", F.lit("human")).limit(50), ["click"], trees=2, depth=2)
    assert one.nodes.count() == 2 and {r["predictedLabel"] for r in one.score(feats.limit(20)).collect()} == {"human"}
    unlabelled = feats.limit(30).withColumn("label", F.when(F.col("id") % 2 == 0, F.col("label")))
    assert fr.grow(unlabelled, [], trees=1, depth=1).nodes.count() >= 1


def test_forest_does_not_depend_on_partitioning(feats):
    a = fr.grow(feats.repartition(3), ["click"], trees=2, depth=3).nodes
    b = fr.grow(feats.repartition(11), ["click"], trees=2, depth=3).nodes
    key = lambda df: sorted(map(str, df.collect()))
    assert key(a) == key(b)


def test_grown_forest_learns(feats):
    """Held-out accuracy well above the larger class."""
    train, test = ml.split(feats)
    f = fr.grow(train, ["click"])
    s = f.score(test, keep=["label"])
    acc = s.agg(F.avg((F.col("label") == F.col("predictedLabel")).cast("double"))).first()[0]
    share = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert acc > share + 0.5 * (1 - share)
