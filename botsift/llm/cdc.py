"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the bytes of a text; a chunk ends where the
hash is small, which depends on the last 16 bytes only, so an insertion
moves the boundaries around it and no others.  Chunks are compared by digest
over the whole corpus: a digest that occurs in two documents is repeated,
and its smallest document keeps it.  Neighbouring repeated chunks that lie
alike in one other document are a candidate; it is extended byte by byte in
both texts to the real ends of the passage.  Passages of at least
``min_bytes`` are reported, shorter ones are chance.

The digests are counted by an aggregate with map-side combine and joined
back by a join that Spark can split, so a passage that a third of all
documents share is a large count and a split join, never one task's list.
Candidates meet the bytes near their ends, and the whole texts only where
those do not show the passage's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift.llm.bitmap import maybe_in
from botsift.llm.words import mix
from botsift.session import materialize

MEAN_CHUNK = 20    # a boundary every so many bytes, beyond the least size
MIN_CHUNK = 12
MAX_CHUNK = 256    # a chunk without boundary ends here
MIN_SPAN = 120     # bytes of a repeated passage that make a finding
CANDIDATE = 24     # bytes of neighbouring repeated chunks that are looked at
NEAR = 128         # bytes around a candidate that are compared first

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CHUNKS = "d bigint, h bigint, digests array<bigint>, ends array<int>"
_SPANS = "d bigint, h bigint, od bigint, oh bigint, s int, e int, delta int, n_chunks bigint, open boolean"


def boundaries(data: bytes, mean: int = MEAN_CHUNK, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of a text (the last is its length)."""
    n = len(data)
    if n == 0:
        return []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8):  # the hash of the last 16 bytes, 4 bits of shift for each
        older = h[:-step] << np.uint64(4 * step) if n > step else h[:0]
        h = h.copy()
        h[step:] += older
    found = (np.flatnonzero(h < np.uint64((1 << 64) // mean)) + 1).tolist()
    ends, last = [], 0
    for e in [*found, n]:
        if e - last < least and e != n:
            continue
        while e - last > most:
            last += most
            ends.append(last)
        if e > last:
            ends.append(e)
            last = e
    return ends


def named_texts(docs: DataFrame) -> DataFrame:
    """Per document row: d (the id, or for rows without one a name of the
    text, above all ids), h (a hash of the text; d and h name a text) and text."""
    x = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    x = x.withColumn("h", F.xxhash64("text"))
    return x.select(F.coalesce("d", F.lit(1 << 62) + F.shiftrightunsigned("h", 2)).alias("d"), "h", "text")


def chunk_table(docs: DataFrame, mean: int = MEAN_CHUNK, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """Per document row: its names d and h, the digests and ends of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ends = [], []
            for text in batch.column("text").cast(pa.binary()):
                data = text.as_py()
                cut = boundaries(data, mean, least, most)
                digests.append(np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip([0, *cut], cut)],
                                        dtype=np.uint64).view(np.int64))
                ends.append(cut)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("h"), pa.array(digests, pa.list_(pa.int64())),
                 pa.array(ends, pa.list_(pa.int32()))], names=["d", "h", "digests", "ends"])

    return named_texts(docs).mapInArrow(run, _CHUNKS)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n, step = min(len(a), len(b)), 64
    i = 0
    while i < n:
        k = min(step, n - i)
        if a[i:i + k] == b[i:i + k]:
            i, step = i + k, step * 2
        elif k == 1:
            break
        else:
            step = k // 2
    return i


def extend(data: bytes, other: bytes, s: int, e: int, at: int) -> tuple[int, int]:
    """The ends of the passage around data[s:e] that ``other`` has too, where
    data[s:e] starts at ``at``."""
    e += _common(data[e:], other[at + e - s:])
    return s - _common(data[:s][::-1], other[:at][::-1]), e


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates extended by the bytes before and after them in both texts;
    ``open`` if these are all alike and no candidate that lies alike is so
    near that it goes on from there."""
    for batch in batches:
        before, after, obefore, oafter = ([x.as_py() for x in batch.column(c)] for c in ("before", "after", "obefore", "oafter"))
        left = [_common(a[::-1], b[::-1]) for a, b in zip(before, obefore)]
        right = [_common(a, b) for a, b in zip(after, oafter)]
        alone = zip(batch.column("alone_left").to_pylist(), batch.column("alone_right").to_pylist())
        yield _moved(batch, left, right, [(a == NEAR and x) or (b == NEAR and y) for a, b, (x, y) in zip(left, right, alone)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates extended in the whole texts."""
    for batch in batches:
        text, other = batch.column("text").cast(pa.binary()), batch.column("other").cast(pa.binary())
        s, e, delta = (batch.column(c).to_pylist() for c in ("s", "e", "delta"))
        ends = [extend(text[i].as_py(), other[i].as_py(), s[i], e[i], s[i] - delta[i]) for i in range(len(s))]
        yield _moved(batch, [x - a for x, (a, _) in zip(s, ends)], [b - x for x, (_, b) in zip(e, ends)], [False] * len(s))


def _moved(batch: pa.RecordBatch, left: list[int], right: list[int], open_: list[bool]) -> pa.RecordBatch:
    of = {c: batch.column(c) for c in ("d", "h", "od", "oh", "s", "e", "delta", "n_chunks")}
    of["s"] = pa.array((np.array(of["s"]) - np.array(left, dtype=np.int32)).astype(np.int32))
    of["e"] = pa.array((np.array(of["e"]) + np.array(right, dtype=np.int32)).astype(np.int32))
    return pa.RecordBatch.from_pydict(of | {"open": pa.array(open_, pa.bool_())})


def _extended(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidates ``runs`` with the ends of their passages."""
    other = [F.col("od").alias("d"), F.col("oh").alias("h"), (F.col("s") - F.col("delta")).alias("s"), (F.col("e") - F.col("delta")).alias("e")]
    asks = runs.select("d", "h", "s", "e").unionByName(runs.select(*other)).distinct()
    asks = materialize(asks.groupBy("d", "h").agg(F.collect_list(F.struct("s", "e")).alias("asks")), "asks")
    x = maybe_in(named_texts(docs), "h", asks.select("h")).join(asks, ["d", "h"])
    x = x.select("d", "h", F.col("text").cast("binary").alias("b"), F.explode("asks").alias("a")).select("d", "h", "a.s", "a.e", "b")
    ends = x.select("d", "h", "s", "e", F.expr(f"substring(b, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR}))").alias("before"),
                    F.expr(f"substring(b, e + 1, {NEAR})").alias("after"))
    ends = materialize(ends.dropDuplicates(["d", "h", "s", "e"]), "ends")
    there = ends.select(F.col("d").alias("od"), F.col("h").alias("oh"), F.col("s").alias("os"), F.col("e").alias("oe"),
                        F.col("before").alias("obefore"), F.col("after").alias("oafter"))
    near = runs.join(ends, ["d", "h", "s", "e"]).withColumns({"os": F.expr("s - delta"), "oe": F.expr("e - delta")})
    near = materialize(near.join(there, ["od", "oh", "os", "oe"]).mapInArrow(_near, _SPANS), "extended")

    left = near.filter("open").drop("open")
    names = left.select("d", "h").unionByName(left.select(F.col("od").alias("d"), F.col("oh").alias("h"))).distinct()
    texts = maybe_in(named_texts(docs), "h", names.select("h")).join(names, ["d", "h"], "left_semi")
    texts = materialize(texts.dropDuplicates(["d", "h"]), "texts")
    both = left.join(texts, ["d", "h"]).join(
        texts.select(F.col("d").alias("od"), F.col("h").alias("oh"), F.col("text").alias("other")), ["od", "oh"])
    return near.filter("NOT open").unionByName(both.mapInArrow(_whole, _SPANS))


def _joined(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans s, e that overlap, within the columns ``by``, as one."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = spans.withColumn("new", F.coalesce(F.col("s") >= before, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(w))
    low = [F.min("lo").alias("lo")] if "lo" in spans.columns else []
    return x.groupBy(*by, "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n_chunks").alias("n_chunks"), *low).drop("part")


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_SPAN, mean: int = MEAN_CHUNK, least: int = MIN_CHUNK,
                   most: int = MAX_CHUNK, candidate: int = CANDIDATE) -> DataFrame:
    """Spans of text that other documents have too: doc_id, span_start,
    span_end (byte offsets), n_chunks (repeated chunks in it), first_doc_id
    (smallest document that has one of its chunks), is_first (this document
    keeps the span).  Passages that overlap are one span.

    Defined results: NULL, empty and short texts have no spans, documents
    without repeats no rows.  Rows that share a doc_id are one document, and
    a repeat inside one document alone is no finding; a row without doc_id is
    a document named by its text (rows of equal text are then one), reported
    with doc_id NULL.  Other columns are ignored.
    """
    t = materialize(chunk_table(docs, mean, least, most), "chunks")
    c = t.select("d", F.explode("digests").alias("digest"))
    shared = c.groupBy("digest").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select("digest")
    at = t.select("d", "h", F.expr("transform(ends, (e, i) -> named_struct('g', digests[i], 's', if(i = 0, 0, ends[i - 1]), 'e', e))"
                                   ).alias("x"))
    at = at.select("d", "h", F.explode("x").alias("x")).select("d", "h", F.col("x.g").alias("digest"), F.col("x.s").alias("s"),
                                                                F.col("x.e").alias("e"))
    at = maybe_in(at, "digest", shared)
    # the first and the last place of a chunk: each place is compared with the first, those of the keeper with the last
    place = F.struct("d", "h", "s")
    places = at.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first.d < last.d")
    rep = at.join(places, "digest").withColumn("o", F.when(F.col("d") == F.col("first.d"), F.col("last")).otherwise(F.col("first")))
    rep = rep.select("d", "h", "s", "e", F.col("o.d").alias("od"), F.col("o.h").alias("oh"),
                     (F.col("s") - F.col("o.s")).alias("delta")).repartition("d", "h").distinct()
    w = Window.partitionBy("d", "h").orderBy("s", "e")
    like = F.struct(F.col("s").alias("e"), "od", "oh", "delta")
    new = F.lag(F.struct("e", "od", "oh", "delta")).over(w).eqNullSafe(like)
    rep = rep.withColumn("new", (~new).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = rep.groupBy("d", "h", "od", "oh", "run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.first("delta").alias("delta"), F.count(F.lit(1)).alias("n_chunks")).filter(
        F.col("e") - F.col("s") >= candidate)
    w = Window.partitionBy("d", "h", "od", "oh", "delta").orderBy("s", "e")
    runs = runs.withColumns({"alone_left": F.coalesce(F.col("s") - F.lag("e").over(w) > NEAR, F.lit(True)),
                             "alone_right": F.coalesce(F.lead("s").over(w) - F.col("e") > NEAR, F.lit(True))})
    found = _extended(materialize(runs.drop("run"), "candidates"), docs).repartition("d", "h")
    # pieces of one passage, long enough; then passages that overlap
    found = _joined(found, ["d", "h", "od", "oh", "delta"]).filter(F.col("e") - F.col("s") >= min_bytes)
    found = found.withColumns({"is_first": F.col("d") < F.col("od"), "lo": F.least("d", "od")})
    spans = _joined(found, ["d", "h", "is_first"]).withColumnsRenamed({"s": "span_start", "e": "span_end"})
    named = lambda c: F.when(F.col(c) < (1 << 62), F.col(c))
    return spans.select(named("d").alias("doc_id"), "span_start", "span_end", "n_chunks",
                        named("lo").alias("first_doc_id"), "is_first")


def drop_repeats(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with every repeated span removed except in the document that
    keeps it.  Rows that share a doc_id and rows without one stay whole."""
    alone = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    cut = repeated_spans(docs, **params).filter("NOT is_first").join(alone.select("doc_id"), "doc_id").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias("cuts"))
    d = docs.select("doc_id", F.struct(*docs.columns).alias("row")).join(cut, "doc_id", "left").select("row", "row.text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                if cuts:
                    data, last, keep = text.encode(), 0, []
                    for c in cuts:
                        keep.append(data[last:c["span_start"]])
                        last = c["span_end"]
                    text = b"".join([*keep, data[last:]]).decode("utf-8", "ignore")  # a cut may fall inside a character
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = d.mapInArrow(run, T.StructType([d.schema["row"], d.schema["text"]]))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
