"""Adapter from the generated test tables to the engine's input tables.

The reference ships no data; its inputs are fetched from a social-network API.
Here every input is *derived by Spark* from the tables under ``sf_dir`` so
that the work grows with them (mapping documented in FIXTURES.md):

  users            customer (+ order counts as followers)
  statuses         events (one post per event)
  labelled lines   events + users: "<label> <user_id> <status ids>"
  text statuses    documents joined to labels, one URL each from pages
  threats          pages (a subset flagged as threat URLs)
  label events     orders (one label correction per order)
  lookup requests  part (requested account ids; some are not accounts)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.functions.columns import epoch_ms

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the adapter.
VERIFIED_BALANCE = 9000.0
PROTECTED_SEGMENT = "BUILDING"
THREAT_TYPES_BY_PARITY = ("MALWARE", "SOCIAL_ENGINEERING")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follower count per account = number of orders (partial aggregation)."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.count(F.lit(1)).alias("followers_count"))
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per account.

    Columns: user_id, screen_name, followers_count, friends_count,
    is_protected, is_verified, label.
    """
    c = table(spark, sf_dir, "customer")
    u = c.join(followers(spark, sf_dir), c.c_custkey == F.col("user_id"), "left")
    fol = F.coalesce(F.col("followers_count"), F.lit(0)).cast("bigint")
    fri = F.col("c_nationkey").cast("bigint")
    return u.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("screen_name"),
        fol.alias("followers_count"),
        fri.alias("friends_count"),
        ((F.col("c_mktsegment") == F.lit(PROTECTED_SEGMENT)) & (F.col("c_custkey") % 5 == 0))
        .alias("is_protected"),
        (F.col("c_acctbal") > F.lit(VERIFIED_BALANCE)).alias("is_verified"),
        F.when(fri > fol, F.lit("bot")).otherwise(F.lit("human")).alias("label"),
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event, with entity arrays like the public status object.

    Columns: status_id, user_id, kind, created_at, created_ms, source, text,
    urls ARRAY<STRUCT<url, expanded_url>>, hashtags ARRAY<STRING>,
    mentions ARRAY<STRING>.
    """
    e = table(spark, sf_dir, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') as int)")
    url = F.struct(
        F.concat(F.lit("https://t.co/e"), F.col("event_id").cast("string")).alias("url"),
        F.concat(
            F.lit("https://events.example/"), F.col("event_type"), F.lit("/"),
            F.col("event_id").cast("string"),
        ).alias("expanded_url"),
    )
    return e.select(
        F.col("event_id").alias("status_id"),
        F.col("user_id"),
        F.lit("timeline").alias("kind"),
        F.col("ts").alias("created_at"),
        epoch_ms("ts").alias("created_ms"),
        F.col("event_type").alias("source"),
        F.col("props").alias("text"),
        F.when(F.col("event_type") == "click", F.array(url))
        .otherwise(F.array().cast("array<struct<url:string,expanded_url:string>>"))
        .alias("urls"),
        F.array_repeat(F.lit("#tag"), k % 3).alias("hashtags"),
        F.array_repeat(F.lit("@someone"), k % 2).alias("mentions"),
    )


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of a labelled-account file, including malformed ones.

    One line per account with posts, by id: label, id, then all its status
    ids in order.  Deliberate defects by id:
      id % 10 == 1  an earlier line gives the account the other label
      id % 10 == 2  post 0 is listed first, whoever wrote it
      id % 10 == 3  the id token is not a number ("u<id>")
      id % 10 == 7  an empty line
      id % 10 == 9  two blanks after the label (an empty token)
      id % 10 == 5  a trailing blank (valid: trailing blanks are ignored)
    """
    s = table(spark, sf_dir, "events").select(
        F.col("user_id"), F.col("event_id").alias("status_id")
    )
    listed = s.groupBy("user_id").agg(F.sort_array(F.collect_list("status_id")).alias("ids"))
    shared = F.concat(F.array(F.lit(0).cast("bigint")), F.array_remove("ids", 0))
    listed = listed.withColumn("ids", F.when(F.col("user_id") % 10 == 2, shared).otherwise(F.col("ids")))
    lab = users(spark, sf_dir).select("user_id", "label")
    j = listed.join(lab, "user_id")
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    uid = F.col("user_id").cast("string")
    m = F.col("user_id") % 10
    line = (
        F.when(m == 3, F.concat_ws(" ", "label", F.concat(F.lit("u"), uid), ids))
        .when(m == 7, F.lit(""))
        .when(m == 9, F.concat(F.col("label"), F.lit("  "), uid, F.lit(" "), ids))
        .when(m == 5, F.concat(F.concat_ws(" ", "label", uid, ids), F.lit(" ")))
        .otherwise(F.concat_ws(" ", "label", uid, ids))
    )
    other = F.when(F.col("label") == "bot", "human").otherwise("bot")
    earlier = F.concat_ws(" ", other, uid, ids)
    lines = F.when(m == 1, F.array(earlier, line)).otherwise(F.array(line))
    return j.orderBy("user_id").select(F.explode(lines).alias("value"))


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled posts for the text model without URLs: status_id, label
    ('bot' when toxic), text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(lab, "doc_id").select(
        F.col("doc_id").alias("status_id"),
        F.when(F.col("toxic") == 1, F.lit("bot")).otherwise(F.lit("human")).alias("label"),
        "text",
    )


def text_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled posts with one URL entity each: a short t.co link expanding
    to the URL of page ``doc_id mod count(pages)``.

    Columns: status_id, label, text, urls.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.select(F.count(F.lit(1))).scalar()
    d = labelled_texts(spark, sf_dir).withColumn("page_id", F.pmod(F.col("status_id"), n_pages))
    d = d.join(pages, "page_id", "left")
    ent = F.struct(
        F.concat(F.lit("https://t.co/d"), F.col("status_id").cast("string")).alias("url"),
        F.col("url").alias("expanded_url"),
    )
    return d.select(
        "status_id", "label", "text",
        F.when(F.col("url").isNotNull(), F.array(ent))
        .otherwise(F.array().cast("array<struct<url:string,expanded_url:string>>"))
        .alias("urls"),
    )


def threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat list: page URLs with page_id % 7 == 0 are flagged (MALWARE or
    SOCIAL_ENGINEERING by parity, WINDOWS, URL); % 7 == 3 rows carry another
    threat type and % 7 == 5 rows another platform, so the filter matters."""
    p = table(spark, sf_dir, "pages")
    m = F.col("page_id") % 7
    ttype = (
        F.when(m == 3, F.lit("UNWANTED_SOFTWARE"))
        .when(F.col("page_id") % 2 == 0, F.lit(THREAT_TYPES_BY_PARITY[0]))
        .otherwise(F.lit(THREAT_TYPES_BY_PARITY[1]))
    )
    return p.filter(m.isin(0, 3, 5)).select(
        F.col("url"),
        ttype.alias("threat_type"),
        F.when(m == 5, F.lit("LINUX")).otherwise(F.lit("WINDOWS")).alias("platform_type"),
        F.lit("URL").alias("threat_entry_type"),
    )


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label corrections in arrival order: one per order (seq = order key)."""
    return _corrections(table(spark, sf_dir, "orders"))


def _corrections(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("human")).otherwise(F.lit("bot")).alias("label"),
    )


def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested account ids (one per part row; ids beyond the customer range
    are not accounts).  ``first_pass`` marks the ids of an earlier ingest."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("user_id"),
        (F.col("p_size") < 20).alias("first_pass"),
    )


def label_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The label corrections as two batches: those of all days but the last,
    and the last day's."""
    o = table(spark, sf_dir, "orders")
    last = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    return _corrections(o.filter(F.col("o_orderdate") < last)), _corrections(o.filter(F.col("o_orderdate") == last))
