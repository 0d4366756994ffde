"""Post text: tokens, term hashing, IDF and the Naive Bayes text model.

Tokenizing is Spark ML's Tokenizer (lower-case, split on single whitespace
characters), a JVM transformer; token statistics are ordinary aggregates.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUM_HASH_FEATURES = 20  # hash buckets of the reference text model (fixed value)


def tokenize(docs: DataFrame, text_col: str = "text", out: str = "words") -> DataFrame:
    return Tokenizer(inputCol=text_col, outputCol=out).transform(docs)


def with_in_row_counts(df: DataFrame, words: str = "words", out: str = "counts") -> DataFrame:
    """Add ``out``: occurrences of each distinct token of the ``words`` array,
    computed inside the row -- sort, mark where each run of equal tokens
    starts, take the distance to the next start.  ARRAY<STRUCT<token, n>>.

    The sorted array and the run starts are their own columns so the
    lambdas only reference attributes: an expression inside a lambda would
    be re-evaluated for every element.  JVM higher-order functions, no
    Python, O(n log n) per row.
    """
    x = df.withColumn("_s", F.array_sort(words)).withColumn("_n", F.size("_s"))
    x = x.withColumn("_starts", F.filter(
        F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))),
        lambda i: (i < F.col("_n")) & ((i == 0) | (F.get(F.col("_s"), i) != F.get(F.col("_s"), i - 1))),
    ))
    runs = F.transform(
        F.col("_starts"),
        lambda st, j: F.struct(
            F.get(F.col("_s"), st).alias("token"),
            (F.coalesce(F.get(F.col("_starts"), j + 1), F.col("_n")) - st).cast("bigint").alias("n"),
        ),
    )
    return x.withColumn(out, runs).drop("_s", "_n", "_starts")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(document, token) -> occurrences, over whole texts.

    All tokens of a document come from one row, so the counts are formed
    inside the row and exploded: no shuffle, and the output keeps the
    documents' partitioning.
    """
    t = with_in_row_counts(tokenize(docs.select(id_col, text_col), text_col))
    # explode_outer: a plain explode makes the optimizer infer size(counts) > 0
    # and push that filter below the projections, re-inlining the sort into
    # every lambda (quadratic).  Empty arrays cannot occur (the tokenizer
    # yields [""] for an empty text); the NULL guard is for NULL texts.
    return t.select(id_col, F.explode_outer("counts").alias("c")).filter(F.col("c").isNotNull()).select(
        id_col, F.col("c.token").alias("token"), F.col("c.n").alias("n")
    )


def idf_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per token: document frequency and idf = ln((m + 1) / (df + 1)), m the
    number of documents (Spark ML's IDF formula, per token instead of per
    hash bucket)."""
    m = docs.select(F.count(F.lit(1))).scalar()
    t = tokenize(docs.select(id_col, text_col), text_col)
    pairs = t.select(id_col, F.explode(F.array_distinct("words")).alias("token"))
    df_ = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df_.select(
        "token", "df",
        F.log((m.cast("double") + F.lit(1.0)) / (F.col("df").cast("double") + F.lit(1.0))).alias("idf"),
    )


def hashed_tf(docs: DataFrame, num_features: int = NUM_HASH_FEATURES, text_col: str = "text") -> DataFrame:
    t = tokenize(docs, text_col)
    return HashingTF(inputCol="words", outputCol="rawFeatures", numFeatures=num_features).transform(t)


def text_pipeline(num_features: int = NUM_HASH_FEATURES, text_col: str = "statusText") -> Pipeline:
    return Pipeline(stages=[
        Tokenizer(inputCol=text_col, outputCol="words"),
        HashingTF(inputCol="words", outputCol="rawFeatures", numFeatures=num_features),
        IDF(inputCol="rawFeatures", outputCol="features"),
        NaiveBayes(featuresCol="features", labelCol="label"),
    ])


def train_text_model(labelled: DataFrame, train_fraction: float = 0.6, seed: int = 207325481,
                     num_features: int = NUM_HASH_FEATURES):
    """Fit on a seeded split; returns (model, predictions on the held-out rows)."""
    if labelled.isEmpty():
        raise ValueError("text model: no labelled statuses to train on")
    train, test = labelled.randomSplit([train_fraction, 1 - train_fraction], seed)
    model = text_pipeline(num_features).fit(train)
    return model, model.transform(test)
