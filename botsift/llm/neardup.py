"""MinHash near-duplicates with tensored banding.

Ordinary banding of T tables of k rows computes T*k minhashes per document.
Here only m small collections of k/2 minhashes are computed; each gives a
*half key*, and every pair of half keys is one table key, so m*k/2 minhashes
feed m(m-1)/2 tables.  Two documents of similarity s meet unless fewer than
two of m half keys agree: with m = 14 halves of 3 minhashes (42 minhashes,
91 tables of 6 rows) that is 7 in 10,000 at s = 0.8 and falls steeply above.

Flow
  1. one pass over the texts writes, per document, the size and a 128-bit
     digest of its full shingle set and its half keys;
  2. documents of equal sets form a class, named by its smallest doc_id;
     only one of each class is hashed into tables;
  3. table keys are combined, buckets with two or more classes are kept;
  4. every class of a bucket is verified on full shingle sets against the
     bucket's smallest class (a star, so the pairs grow with the rows of a
     bucket, not with their square), and the links' components are found;
  5. pairs of a bucket that are still in different components are verified
     too, unless too few of a set's shingles occur in other components at
     all, so that no link that could join two components is lost.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.llm.components import connected_components
from botsift.llm.links import bucket_links, shared_buckets
from botsift.llm.words import WordHashes, mix, window_hashes
from botsift.session import materialize

HALF_KEYS = 14        # small hash collections
HALF_ROWS = 3         # minhashes in each
BLOCK = 8192          # shingles hashed at once (bounds a task's memory)
CACHED_SETS = 256     # shingle sets a verifying task remembers (a speed setting)

_SIGNATURE = "doc_id bigint, n_shingles bigint, digest binary, half array<bigint>"


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return seeds[:n] | np.uint64(1), seeds[n:]


def half_keys(shingles: np.ndarray, m: int, rows: int) -> np.ndarray:
    """m half keys (int64), each of ``rows`` minhashes of a shingle set."""
    mul, add = _families(m * rows)
    low = np.full(m * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), BLOCK):
        x = shingles[None, i:i + BLOCK] * mul[:, None] + add[:, None]
        low = np.minimum(low, x.min(axis=1))
    acc = np.zeros(m, dtype=np.uint64)
    for part in low.reshape(m, rows).T:
        acc = mix(acc + part)
    return acc.view(np.int64)


def signatures(docs: DataFrame, k: int, m: int = HALF_KEYS, rows: int = HALF_ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, digest of the shingle set, half keys
    (none for a document without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, digests, halves = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = (text.as_py() or b"").lower().split()
                s = np.unique(window_hashes(hashes.of(words), k))
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                halves.append(half_keys(s, m, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "half"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, _SIGNATURE)


def table_keys(reps: DataFrame, m: int = HALF_KEYS) -> DataFrame:
    """One row per class and table: each pair of half keys makes one key."""
    h = F.col("half")
    keys = [F.xxhash64(F.lit(i * m + j), h[i], h[j]) for i in range(m) for j in range(i + 1, m)]
    return reps.select("node", F.col("n_shingles").alias("n"), F.explode(F.array(*keys)).alias("key"))


def _sets(k: int):
    """node -> full shingle set of a text, with a small memory."""
    memory: OrderedDict = OrderedDict()

    def of(node: int, text: bytes):
        key = (node, len(text), text[:64], text[-64:])  # rows may share a doc_id
        if key in memory:
            memory.move_to_end(key)
            return memory[key]
        words = text.lower().split()
        found = set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()
        memory[key] = found
        if len(memory) > CACHED_SETS:
            memory.popitem(last=False)
        return found

    return of


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have
    100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _sets(k)
        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
            ta, tb = ta.cast(pa.binary()), tb.cast(pa.binary())
            ok = []
            for i in range(batch.num_rows):
                x, y = of(a[i].as_py(), ta[i].as_py()), of(b[i].as_py(), tb[i].as_py())
                both = len(x & y)
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(
        run, "a bigint, b bigint")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, s): the distinct shingles of every text, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [np.unique(window_hashes(hashes.of(t.as_py().lower().split()), k)).view(np.int64)
                    for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, s array<bigint>")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, m: int = HALF_KEYS,
                    rows: int = HALF_ROWS) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, kept.

    Words are spaced words with A-Z lower-cased; the set of a document is its
    distinct runs of ``shingle_words`` words (a shorter text is one run).
    Documents are linked at 100 * intersection >= percent * union.

    Defined results: a NULL, empty or wordless text has no shingles and is
    linked with nothing.  Rows that share a doc_id count as one document: what
    any of them is linked with, all are.  A row without a doc_id is its own
    component (component_id NULL) and kept.  Columns besides doc_id and text
    are ignored.  An empty table gives an empty result.
    """
    sig = materialize(signatures(docs, shingle_words, m, rows), "signatures")
    full = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    reps = full.join(classes, "digest").filter("doc_id = node").select("node", "n_shingles", "half")

    buckets = shared_buckets(table_keys(reps, m))
    ids = buckets.select(F.col("node").alias("doc_id")).distinct()
    texts = materialize(
        docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id")
        .select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text")), "candidates")
    sizes = reps.select("node", F.col("n_shingles").alias("n"))
    links = bucket_links(
        buckets, sizes, lambda nodes: shingle_sets(texts.join(nodes, "node", "left_semi"), shingle_words),
        lambda pairs: verify(pairs, texts, shingle_words, percent), percent)

    # rows of one doc_id are one document: join the classes that they name
    same = full.join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comp = connected_components(links.unionByName(same.filter("a <> b")))
    out = sig.select("doc_id", "n_shingles").join(
        comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("doc_id").isNull() | F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; all columns
    stay.

    Rows of one doc_id are one document, kept or dropped together, but of
    rows with one id and one text only one stays.  A row without an id is
    named by its text (with a number of 2^62 or more, above ids), so copies
    without ids are one document; it is kept only if no row with an id is a
    near duplicate of it.  Rows without an id and without text all stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # unnamed rows come after all others: the smallest id of a component is kept
    name = F.coalesce(F.col("doc_id").cast("bigint"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62))
    d = docs.select(F.struct(*docs.columns).alias("row"), name.alias("doc_id"), text.alias("text"))
    d = d.withColumn("copy", F.xxhash64("doc_id", "text", F.lit(5)))
    lost = near_duplicates(d.select("doc_id", "text"), **params).filter(~F.col("kept")).select("doc_id").distinct()
    lost = materialize(lost, "near-duplicates")
    d = d.join(lost, "doc_id", "left_anti")
    # of equal rows of one name, one stays; only names that repeat are gathered
    known = F.col("row.doc_id").isNotNull() | (F.col("text") != "")
    again = d.filter(known).groupBy("copy").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("copy")
    again = materialize(again, "repeated-rows")
    alone = d.join(again, "copy", "left_anti").select("row")
    first = d.join(again, "copy", "left_semi").groupBy("doc_id", "text").agg(F.first("row").alias("row")).select("row")
    return alone.unionByName(first).select("row.*")
