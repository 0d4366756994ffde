"""Multinomial Naive Bayes over hashed TF-IDF terms, as grouped aggregates.

The model is three small tables whose sizes are set by the numbers of buckets
and labels, whatever the corpus: log priors per label, IDF per bucket, and
smoothed log likelihoods per (label, bucket).  They are sums of integer term
counts, combined on the map side, so the parameters do not depend on
partitioning.  Terms are hashed with MD5, which every SQL engine has too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botsift.operators.text import NUM_HASH_FEATURES, tokenize
from botsift.session import materialize

SMOOTHING = 1.0


def bucket_of(token: Column, buckets: int = NUM_HASH_FEATURES) -> Column:
    """A token's bucket: the first 13 hex digits of its MD5, modulo."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 13), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def hashed_terms(rows: DataFrame, keys: list[str], text_col: str = "statusText", buckets: int = NUM_HASH_FEATURES) -> DataFrame:
    """keys, bucket, n: term occurrences per row and bucket.  A row's terms
    come from one task, so at most ``buckets`` rows per text are shuffled.
    NULL texts have no terms; rows with equal keys are counted together."""
    t = tokenize(rows.filter(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("_text")), "_text", "_words")
    t = t.select(*keys, F.explode("_words").alias("_token")).select(*keys, bucket_of(F.col("_token"), buckets).alias("bucket"))
    return t.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class BayesModel:
    priors: DataFrame        # label, log_prior
    idf: DataFrame           # bucket, idf
    likelihoods: DataFrame   # label, bucket, log_likelihood
    buckets: int


def fit(rows: DataFrame, keys: list[str], label: str = "label", text_col: str = "statusText",
        buckets: int = NUM_HASH_FEATURES, smoothing: float = SMOOTHING) -> BayesModel:
    """Fit on labelled rows, one per ``keys`` (which include the label).

    idf = ln((rows + 1) / (rows with the bucket + 1)); a label's prior and a
    (label, bucket)'s likelihood are shares with ``smoothing`` added to every
    count, the counts of the likelihood being TF-IDF weights.  Rows without a
    label do not count; a label's buckets without terms are smoothed zeros.
    An empty table gives an empty model, which predicts nothing.
    """
    rows = rows.filter(F.col(label).isNotNull())
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    n = materialize(n, "label-rows")
    total, labels = n.select(F.sum("n")).scalar(), n.select(F.count(F.lit(1))).scalar()
    priors = n.select("label", (F.log(F.col("n") + smoothing) - F.log(total + smoothing * labels)).alias("log_prior"))

    terms = materialize(hashed_terms(rows, keys, text_col, buckets), "hashed-terms")
    # one pass over the term rows gives both tables: at most labels x buckets sums
    sums = terms.groupBy(F.col(label).alias("label"), "bucket").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    sums = materialize(sums, "term-sums")
    every = n.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    df = every.join(sums.groupBy("bucket").agg(F.sum("df").alias("df")), "bucket", "left")
    idf = df.select("bucket", F.log((total + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)).alias("idf"))
    idf = materialize(idf, "idf")
    grid = n.select("label", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    w = grid.join(sums, ["label", "bucket"], "left").join(idf, "bucket").select(
        "label", "bucket", (F.coalesce("tf", F.lit(0)) * F.col("idf")).alias("w"))
    w = materialize(w, "term-weights")
    per = w.groupBy("label").agg(F.sum("w").alias("all"))
    like = w.join(per, "label").select(
        "label", "bucket", (F.log(F.col("w") + smoothing) - F.log(F.col("all") + smoothing * buckets)).alias("log_likelihood"))
    return BayesModel(materialize(priors, "priors"), idf, materialize(like, "likelihoods"), buckets)


def predict(model: BayesModel, rows: DataFrame, keys: list[str], text_col: str = "statusText") -> DataFrame:
    """keys, prediction, probability (of the prediction).  One row per keys;
    of equal scores the smaller label wins; a NULL text is scored by the
    priors alone."""
    terms = hashed_terms(rows, keys, text_col, model.buckets)
    one = model.likelihoods.join(model.idf, "bucket").select("bucket", "label", (F.col("idf") * F.col("log_likelihood")).alias("x"))
    one = one.withColumnRenamed("label", "_class")
    # a text's few (bucket, n) rows stay together: scores are sums per text and class
    sums = terms.join(one, "bucket").groupBy(*keys, "_class").agg(F.sum(F.col("n") * F.col("x")).alias("_x"))
    classes = model.priors.agg(F.sort_array(F.collect_list(F.struct("label", "log_prior"))).alias("c"))  # one short row
    every = rows.select(*keys).distinct().select(*keys, F.explode(classes.select("c").scalar()).alias("c"))
    s = every.select(*keys, F.col("c.label").alias("_class"), F.col("c.log_prior").alias("_p"))
    j = s.join(sums, [*keys, "_class"], "left").select(*keys, "_class", (F.col("_p") + F.coalesce("_x", F.lit(0.0))).alias("_score"))
    best = j.groupBy(*keys).agg(F.max(F.struct("_score", (-F.col("_class")).alias("_c"))).alias("b"),
                                F.collect_list("_score").alias("all"))
    weight = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("b._score")))
    return best.select(*keys, (-F.col("b._c")).alias("prediction"), (1.0 / weight).alias("probability"))
