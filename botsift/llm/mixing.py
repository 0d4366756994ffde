"""Mixing sources to target weights.

Tokens are summed per source, targets are shared out by weight with a cap per
source, and every document is emitted floor(rate) times plus one Bernoulli
copy whose probability is the rate's fraction.  The draw is a hash of the
seed and the document, so reruns and lost tasks repeat it exactly, and no
document is ever collected or ordered: the decision is a map over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botsift.llm.words import spaced_count
from botsift.session import materialize

WEIGHTS = (3, 1, 2)   # weights of the sources in code point order, repeating
SHARE = 1.5           # mixed words, as a multiple of all words
MAX_RATE = 2          # a source is repeated this often at most
SEED = "mix-1"


def source_sizes(docs: DataFrame, size: str, source: str = "source") -> DataFrame:
    """Per source (NULL is one): its words and its place in code point order,
    NULL last, counted from 0.

    The order is a distributed sort; a source's place is its place within
    its sorted partition plus the rows of the partitions before, so that no
    task ever holds all sources.
    """
    s = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    s = s.orderBy(F.col("source").asc_nulls_last())
    s = materialize(s.withColumn("_id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_id", 33)
    # one row per sorted partition, so this window is over a handful of rows
    before = s.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return s.withColumn("part", part).join(before, "part").select("source", "source_size", (row + F.col("before")).alias("place"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE) -> DataFrame:
    """source, source_size, target: ``share`` of all words shared by weight;
    what is above ``max_rate`` times a source's size goes to the others by
    weight until none is above.

    All sources below their cap stand at one level per unit of weight; the
    level only rises as sources reach their caps, so a few aggregates over
    the source table find it (each brings two sums to the driver).
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = materialize(sources.select("source", "source_size", w.cast("bigint").alias("weight")), "weights")
    cap = F.col("source_size") * max_rate
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        over = F.lit(False) if level is None else cap.cast("double") < F.lit(level) * F.col("weight")
        r = s.agg(F.sum(F.when(over, cap).otherwise(0)).alias("capped"),
                  F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        rise = (share * total - r["capped"]) / r["open"]
        if level is not None and rise <= level:
            break
        level = rise
    level = float("inf") if level is None or not r["open"] else level
    target = F.when(cap.cast("double") < F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(
        F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def uniform(*cols: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the values only: the
    first 52 bits of their MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``docs`` as a struct ``_row`` with size, source_size, target and copies
    (how often the mix takes the document), one row per input row.

    Defined results: a NULL text has size 0; rows without a source form a
    source of their own; a document without id is drawn by its text; equal
    rows are drawn alike; a source without words is not repeated (copies 0).
    An empty table mixes to an empty table.
    """
    d = docs.select(F.struct(*docs.columns).alias("_row"))
    size = spaced_count(F.col("_row")["text"])
    t = targets(source_sizes(d.select(F.col("_row")["source"].alias("source"), size.alias("size")), "size"),
                weights, share, max_rate)
    t = materialize(t.withColumnRenamed("source", "_s"), "targets")
    j = d.withColumn("size", size).join(t, F.col("_row")["source"].eqNullSafe(F.col("_s")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.coalesce(F.col("_row")["doc_id"].cast("string"), F.md5(F.coalesce(F.col("_row")["text"], F.lit(""))))
    copies = F.floor(rate) + F.when(uniform(key, seed=seed) < rate - F.floor(rate), 1).otherwise(0)
    return j.select("_row", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every document repeated ``copies`` times."""
    m = mix(docs, **params)
    return m.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_c")).select("_row.*")
