"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

A group is all documents of one text.  Every group has a size vector (bytes,
tokens, rows); the greedy packer takes items from large to small and puts
each into the shard where the dot product of its vector with the shard's
residual capacity is highest, among the shards it fits into.

The packer is sequential, so it must not see one item per group: groups
smaller than a bundle's share are gathered by hash into a fixed number of
bundles, and a group larger than half a shard is cut by hash into pieces.
That leaves at most about three items per bundle, whatever the corpus holds,
and only their vectors reach the driver; documents find their shard by a map
over the rows with the small item table.

``bytes`` is the law that holds exactly: shard sizes are near equal.  Tokens
and rows are balanced as far as the groups allow: a group that is a large
share of the rows, but not of the bytes, stays in one shard.

Pieces and slots follow a hash of the id.  Where so many rows have one id, or
none, that they would pile up in one piece or bucket, the rows are written
with numbers first, and the hash is of those too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botsift.llm.words import spaced_count
from botsift.session import materialize

SHARDS = 16
BUNDLES_PER_SHARD = 512   # small groups are gathered into so many bundles per shard
LEVELLED = 768            # small items of a shard that levelling looks at
SLOT_BUCKETS = 128        # slots of a shard are numbered in so many ordered parts

_DIMS = ("bytes", "tokens", "rows")


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of the text (NULL: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _group(text: Column) -> list[Column]:
    """128 bits that name a text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t, F.lit(1)), F.xxhash64(F.lit(2), t, text.isNull())]


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: by largest share of any dimension first, where the
    dot product of the item's share with the residual capacity is highest
    among the shards it fits into in every dimension; if it fits nowhere,
    where the scarcest dimension is least exceeded.  Then ``_level``."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1)
    left = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), dtype=np.int32)
    for i in np.lexsort((np.arange(len(vectors)), -share.max(axis=1, initial=0.0))):
        after = left - share[i]
        fits = (after >= 0).all(axis=1)
        out[i] = s = int(np.argmax(np.where(fits, left @ share[i], -np.inf) if fits.any() else after.min(axis=1)))
        left[s] -= share[i]
    _level(share, out, shards)
    return out


def _level(share: np.ndarray, out: np.ndarray, shards: int, rounds: int = 500) -> None:
    """Even the bytes out: between the shards with most and least bytes, the
    move or swap of (small) items that leaves both nearest to equal, bytes
    counting ten times the other dimensions, while there is one that helps."""
    load = np.stack([share[out == s].sum(axis=0) for s in range(shards)])
    goal, weight = 1.0 / shards, np.array([10.0] + [1.0] * (share.shape[1] - 1))

    def off(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(a - goal), np.abs(b - goal)) @ weight

    for _ in range(rounds):
        a, b = int(np.argmax(load[:, 0])), int(np.argmin(load[:, 0]))
        smallest = [np.flatnonzero(out == s) for s in (a, b)]
        ia, ib = (x[np.argsort(share[x, 0], kind="stable")[:LEVELLED]] for x in smallest)
        if a == b or not len(ia):
            return
        moved = share[ia][:, None, :] - np.vstack([np.zeros(share.shape[1]), share[ib]])[None, :, :]
        cost = off(load[a] - moved, load[b] + moved)
        i, j = np.unravel_index(int(np.argmin(cost)), cost.shape)
        if cost[i, j] >= off(load[a], load[b]) - 1e-12:
            return
        load[a] -= moved[i, j]
        load[b] += moved[i, j]
        out[ia[i]] = b
        if j:
            out[ib[j - 1]] = a


def assign_shards(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES_PER_SHARD,
                  keep: list[str] | None = None) -> DataFrame:
    """One row per document row: ``_row`` (its columns ``keep``, all by
    default), size, text_crc32, shard, slot (gapless from 0 in its shard).

    Documents of one text share a shard unless their bytes exceed half of a
    shard's fair share; such a group is cut by hash into pieces.

    Defined results: a NULL text has size 1 and CRC 0 and is a text of its own;
    ids may be NULL or repeat, every row gets a slot; slots follow a hash of
    the row.  An empty table gives no rows.
    """
    if shards < 1 or bundles < 1:
        raise ValueError("shards and bundles must be positive")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    d = docs.select(F.struct(*(keep or docs.columns)).alias("_row"), "text", "doc_id")
    g1, g2 = _group(text)

    def sizes(rows: DataFrame, r: Column) -> DataFrame:
        return materialize(rows.select(
            g1.alias("g1"), g2.alias("g2"), utf8_size(text).alias("bytes"), spaced_count(text).alias("tokens"), r.alias("r")), "sizes")

    r = F.xxhash64("doc_id", F.lit(3))
    meta = sizes(d, r)
    same = meta.groupBy("r").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if (same["most"] or 0) > 1 and same["most"] * shards * SLOT_BUCKETS > same["rows"]:
        d = materialize(d.withColumn("n", F.monotonically_increasing_id()), "numbered-rows")
        r = F.xxhash64("doc_id", "n", F.lit(3))
        meta = sizes(d, r)
    groups = meta.groupBy("g1", "g2").agg(
        F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = materialize(groups, "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    n = shards * bundles
    small = F.col("bytes") * n <= total              # joins a bundle
    large = F.col("bytes") * (2 * shards) > total    # is cut into pieces; at most 2 * shards groups are
    pieces = F.ceil(F.col("bytes") * n / F.lit(float(max(total, 1)))).cast("int")

    # pieces of the cut groups (fewer than 2 * shards): their rows are dealt by a hash of the row
    cut = groups.filter(large & ~small).select("g1", "g2", pieces.alias("pieces"))
    cut_rows = meta.join(F.broadcast(cut), ["g1", "g2"]).groupBy("g1", "g2", F.pmod("r", "pieces").cast("int").alias("piece")).agg(
        F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    whole = groups.filter(~large & ~small).withColumn("piece", F.lit(0))
    bundled = groups.filter(small).groupBy(F.pmod("g1", F.lit(n)).alias("g1")).agg(
        *[F.sum(c).alias(c) for c in _DIMS]).withColumns({"g2": F.lit(None).cast("bigint"), "piece": F.lit(0)})
    items = [r.asDict() for r in cut_rows.unionByName(whole).unionByName(bundled).orderBy(
        F.col("bytes").desc(), "g1", "g2", "piece").collect()]  # at most about 3 * shards * bundles rows
    where = pack(np.array([[r[c] for c in _DIMS] for r in items], dtype=float).reshape(-1, 3), shards)
    placed = materialize(spark.createDataFrame(
        [(r["g1"], r["g2"], r["piece"], int(s)) for r, s in zip(items, where)],
        "i1 bigint, i2 bigint, piece int, shard int"), "items")

    # every row finds its item: through its group if that is one, else its bundle
    own = groups.filter(~small).select("g1", "g2", F.when(large, pieces).otherwise(F.lit(1)).alias("pieces"))
    x = d.select("_row", g1.alias("g1"), g2.alias("g2"), utf8_size(text).alias("size"),
                 F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
                 r.alias("r")).join(F.broadcast(own), ["g1", "g2"], "left")
    x = x.withColumns({
        "i1": F.when(F.col("pieces").isNull(), F.pmod("g1", F.lit(n))).otherwise(F.col("g1")),
        "i2": F.when(F.col("pieces").isNotNull(), F.col("g2")),
        "piece": F.coalesce(F.pmod("r", "pieces"), F.lit(0)).cast("int")})
    x = x.alias("x").join(F.broadcast(placed).alias("p"), (F.col("x.i1") == F.col("p.i1")) & F.col("x.i2").eqNullSafe(
        F.col("p.i2")) & (F.col("x.piece") == F.col("p.piece"))).select("_row", "size", "text_crc32", "shard", "r", F.col("x.g1").alias("g1"))
    return _numbered(x)


def _numbered(x: DataFrame) -> DataFrame:
    """Adds slot: gapless within the shard.  Every shard is cut by hash into
    ordered buckets; a bucket's rows are numbered on their own, after the
    rows of the buckets before it."""
    x = x.withColumn("bucket", F.pmod(F.xxhash64("r", "g1"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = x.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    w = Window.partitionBy("shard", "bucket").orderBy("r", "g1")
    y = x.withColumn("rank", F.row_number().over(w) - 1).join(F.broadcast(before), ["shard", "bucket"])  # shards x buckets rows
    return y.select("_row", "size", "text_crc32", "shard", (F.col("rank") + F.col("before")).cast("bigint").alias("slot"))
