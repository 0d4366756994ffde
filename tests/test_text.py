"""Text path: hashed term frequencies against an independent SQL
formulation (Spark SQL's murmur3 ``hash`` with the same seed), in-row token
counts against a plain explode + group by, IDF formula."""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from botsift.operators import text
from botsift.sources import fixtures as fix


def test_hashing_tf_matches_index_of(spark, sf_small):
    """Bucket counts equal token counts grouped by HashingTF.indexOf.  (SQL's
    hash() is not usable: HashingTF hashes with the fixed murmur3 variant of
    Spark 3, SQL hash() with the older one.)"""
    from pyspark.ml.feature import HashingTF

    docs = fix.labelled_texts(spark, sf_small)
    tf = text.hashed_tf(docs).select("status_id", vector_to_array("rawFeatures").alias("tf"))
    got = tf.select("status_id", F.posexplode("tf").alias("bucket", "n")).filter("n > 0") \
        .select("status_id", "bucket", F.col("n").cast("bigint").alias("n"))
    words = text.tokenize(docs).select("status_id", F.explode("words").alias("token"))
    h = HashingTF(numFeatures=text.NUM_HASH_FEATURES)
    vocab = [r["token"] for r in words.select("token").distinct().collect()]
    buckets = spark.createDataFrame([(t, h.indexOf(t)) for t in vocab], "token string, bucket int")
    want = words.join(buckets, "token").groupBy("status_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_in_row_counts_equal_group_by(spark, sf_small):
    docs = fix.table(spark, sf_small, "documents")
    got = text.token_counts(docs)
    words = text.tokenize(docs).select("doc_id", F.explode("words").alias("token"))
    want = words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_idf_formula(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c a")], "doc_id long, text string")
    got = {r["token"]: (r["df"], r["idf"]) for r in text.idf_tokens(docs).collect()}
    assert got["a"] == (3, math.log(4 / 4))
    assert got["b"] == (1, math.log(4 / 2))


def test_empty_text_model_raises(spark):
    import pytest

    empty = spark.createDataFrame([], "label double, statusText string")
    with pytest.raises(ValueError, match="no labelled statuses"):
        text.train_text_model(empty)  # V20
