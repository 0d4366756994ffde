"""Naive Bayes by aggregates against Spark ML's NaiveBayes on the same
vectors, and against the formula in plain Python."""

import hashlib
import math

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from botsift.operators import bayes
from botsift.sources import fixtures as fix

KEYS = ["status_id", "label"]


@pytest.fixture(scope="module")
def rows(spark):
    t = fix.labelled_texts(spark, "/root/testdata/sf0.01")
    return t.select("status_id", F.when(F.col("label") == "bot", 1.0).otherwise(0.0).alias("label"), F.col("text").alias("statusText")).cache()


@pytest.fixture(scope="module")
def model(rows):
    return bayes.fit(rows, KEYS)


def test_parameters_and_predictions_equal_spark_ml(spark, rows, model):
    idf = {r["bucket"]: r["idf"] for r in model.idf.collect()}
    vec = {}
    for r in bayes.hashed_terms(rows, KEYS).collect():
        vec.setdefault((r["status_id"], r["label"]), [0.0] * 20)[r["bucket"]] = r["n"] * idf[r["bucket"]]
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("status_id", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    df = spark.createDataFrame([(i, y, Vectors.dense(v)) for (i, y), v in vec.items()], schema)
    nb = NaiveBayes(smoothing=1.0).fit(df)
    pi = {r["label"]: r["log_prior"] for r in model.priors.collect()}
    theta = {(r["label"], r["bucket"]): r["log_likelihood"] for r in model.likelihoods.collect()}
    for c in (0, 1):
        assert abs(nb.pi[c] - pi[float(c)]) < 1e-9
        assert all(abs(nb.theta.toArray()[c][b] - theta[float(c), b]) < 1e-9 for b in range(20))
    want = {r["status_id"]: (r["prediction"], max(r["probability"])) for r in nb.transform(df).collect()}
    got = {r["status_id"]: (r["prediction"], r["probability"]) for r in bayes.predict(model, rows, KEYS).collect()}
    assert got.keys() == want.keys() and {p for p, _ in got.values()} == {0.0, 1.0}
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_small_table_by_hand(spark):
    data = [(1, 0.0, "a b a"), (2, 0.0, "b c"), (3, 1.0, "c c d"), (4, 1.0, None), (5, None, "a a")]
    df = spark.createDataFrame(data, "status_id long, label double, statusText string")
    m = bayes.fit(df, KEYS, buckets=5)
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:13], 16) % 5
    train = [(y, [bucket(t) for t in s.split(" ")] if s else []) for _, y, s in data if y is not None]
    idf = [math.log(5 / (sum(b in ts for _, ts in train) + 1)) for b in range(5)]
    assert all(abs(r["idf"] - idf[r["bucket"]]) < 1e-12 for r in m.idf.collect())
    theta = {}
    for y in (0.0, 1.0):
        w = [idf[b] * sum(ts.count(b) for c, ts in train if c == y) for b in range(5)]
        for b in range(5):
            theta[y, b] = math.log(w[b] + 1) - math.log(sum(w) + 5)
    assert all(abs(r["log_likelihood"] - theta[r["label"], r["bucket"]]) < 1e-12 for r in m.likelihoods.collect())
    got = {r["status_id"]: r for r in bayes.predict(m, df.filter("label IS NOT NULL"), KEYS).collect()}
    for i, y, s in data[:4]:
        score = [math.log(3) - math.log(6) + sum(idf[bucket(t)] * theta[c, bucket(t)] for t in (s or "").split(" ") if t) for c in (0.0, 1.0)]
        assert got[i]["prediction"] == float(score.index(max(score)))
        assert abs(got[i]["probability"] - 1 / sum(math.exp(x - max(score)) for x in score)) < 1e-12


def test_empty_training_set_and_empty_rows(spark, model):
    none = spark.createDataFrame([], "status_id long, label double, statusText string")
    m = bayes.fit(none, KEYS)
    assert m.priors.count() == m.likelihoods.count() == 0
    assert bayes.predict(m, spark.createDataFrame([(1, 0.0, "a")], none.schema), KEYS).count() == 0
    assert bayes.predict(model, none, KEYS).count() == 0


def test_parameters_do_not_depend_on_partitioning(rows, model):
    other = bayes.fit(rows.repartition(13), KEYS)
    key = lambda df: sorted((r["label"], r["bucket"], round(r["log_likelihood"], 12)) for r in df.collect())
    assert key(other.likelihoods) == key(model.likelihoods)
