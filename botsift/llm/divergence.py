"""Source divergence audit: how differently the sources of a language use its terms.

Counts per (language, source, term) are formed while the texts are read and
summed by aggregates.  The terms of a language that enough documents have get
ids, frequent terms first, and are cut into blocks of ids; a task gets one
block of two chunks of sources, never a whole group, language or vocabulary.

In a block every source is a segment tree over the term ids.  Trees are
hash-consed: a leaf is a count, an inner node a pair of nodes, and equal
subtrees are one node, within a tree and between sources.  Two trees are
walked at the same time from their roots; equal pairs of nodes are merged with
their multiplicity at each level, so each is priced once however often it
occurs.  Rare terms make most of a vocabulary and nearly equal subtrees, so
few pairs reach the leaves.  All arithmetic is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botsift.session import materialize

MIN_DOCS = 10          # documents of the language that a kept term occurs in, at least
TOP_TERMS = 10         # ranks of the term report
SCALE = 1_000_000_000  # shares are integers out of so many
SMOOTH = 2             # added to every count
BLOCK = 2048           # term ids of a block (a power of two)
CHUNK = 32             # sources of a chunk; a task walks the pairs of two chunks
HELD_TERMS = 200_000   # counts that a reading task holds before it hands them on (a memory setting only)
PIECE_BYTES = 1 << 20  # bytes of a text that are split into terms at once

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_NOT_TERM = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, only A-Z lower-cased, in pieces."""
    at = 0
    while at < len(text):
        m = _NOT_TERM.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
        end = m.start() if m else len(text)
        yield _TERM.findall(text[at:end].lower())
        at = max(end, at + 1)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that have the term).
    NULL lang, source and text are read as ''."""
    text = F.coalesce(F.make_valid_utf8(F.col("text").cast("string")), F.lit("")).cast("binary")
    rows = docs.select(*_names(), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                    pa.array(terms.keys(), pa.binary()).cast(pa.string()),
                    pa.array([v[0] for v in terms.values()], pa.int64()), pa.array([v[1] for v in terms.values()], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own: dict[bytes, int] = {}
                for terms in terms_of(text.as_py()):
                    for t in terms:
                        own[t] = own.get(t, 0) + 1
                group = held.setdefault((lang, source), {})
                size -= len(group)
                for t, n in own.items():
                    if v := group.get(t):
                        v[0] += n
                        v[1] += 1
                    else:
                        group[t] = [n, 1]
                size += len(group)
                if size > HELD_TERMS:
                    yield from hand_on()
                    held, size = {}, 0
        yield from hand_on()

    part = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _names():
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def numbered_terms(kept: DataFrame) -> DataFrame:
    """``kept`` (lang, term, n) with each term's place in its language from 0,
    frequent terms first.  The order is a distributed sort; a place is the
    row's place in its sorted partition plus the rows before that partition,
    less those of the languages before."""
    s = kept.orderBy("lang", F.desc("n"), "term").withColumn("_id", F.monotonically_increasing_id())
    s = materialize(s, "sorted-terms")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per sorted partition, so this window is over a handful of rows
    before = s.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).select(
        "part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    s = s.withColumn("part", part).join(before, "part").withColumn("place", row + F.col("before"))
    first = s.groupBy("lang").agg(F.min("place").alias("first"))
    return s.join(first, "lang").select("lang", "term", F.col("n").alias("lang_n"), (F.col("place") - F.col("first")).alias("place"))


def share(count, total):
    """1 + floor(SCALE * (count + SMOOTH) / total), exact for any long."""
    return (F.lit(1) + F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {SMOOTH} AS DECIMAL(20,0))) "
                              f"div CAST({total} AS DECIMAL(20,0))")).cast("bigint")


def price(p, q):
    """floor((p - q)^2 / (p + q)) of two shares (below 2^31, so exact)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def segment_trees(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hash-consed segment trees of the rows of ``counts`` (trees x width, the
    width a power of two): the counts of the leaf nodes, and per level from
    the leaves' parents up the (left, right) nodes of each node.  The last
    level holds the roots; a row's root is ``roots(...)``.  Equal subtrees,
    of one row or of several, are one node."""
    leaves, node = np.unique(counts, return_inverse=True)
    node = node.reshape(counts.shape)
    levels = []
    while node.shape[1] > 1:
        left, right = node[:, 0::2], node[:, 1::2]
        width = int(node.max()) + 1
        key, at = np.unique(left.astype(np.int64) * width + right, return_inverse=True)
        levels.append(np.stack([key // width, key % width], axis=1))
        node = at.reshape(left.shape)
    levels.append(node[:, 0])
    return leaves, levels


def walk(levels: list[np.ndarray], a: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Simultaneous traversal of tree ``a`` with each of the trees ``others``:
    (index into others, leaf of a, leaf of the other, how often the pair of
    leaves occurs at one term).  At each level equal pairs of nodes are one,
    with their multiplicity."""
    roots = levels[-1]
    at = np.arange(len(others))
    x, y, times = np.full(len(others), roots[a]), roots[others], np.ones(len(others), np.int64)
    for children in reversed(levels[:-1]):
        at, times = np.tile(at, 2), np.tile(times, 2)
        x, y = np.concatenate([children[x, 0], children[x, 1]]), np.concatenate([children[y, 0], children[y, 1]])
        wide = int(max(x.max(), y.max())) + 1
        key = (at.astype(np.int64) * wide + x) * wide + y
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at, x, y = at[first], x[first], y[first]
        times = np.bincount(inverse, weights=times, minlength=len(key)).astype(np.int64)
    return at, x, y, times


def _shares(leaves: np.ndarray, totals: list[int]) -> np.ndarray:
    """Groups x leaves: the share of every count in every group, by Python's
    integers, once per distinct count and total."""
    top = [SCALE * (int(c) + SMOOTH) for c in leaves]
    rows = {t: np.array([1 + c // t for c in top], np.int64) for t in set(totals)}
    return np.stack([rows[t] for t in totals])


def pair_prices(counts: np.ndarray, width: int, totals: list[int], pairs: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """For each (a, others) of ``pairs``: the summed prices of the rows a and
    others of ``counts`` (groups x width, the rest of a full block beyond
    ``width`` counts as nothing).  ``totals`` are the groups' N + SMOOTH * V."""
    full = 1 << max(0, (width - 1).bit_length())
    padded = np.full((len(counts), full), -1, np.int64)  # -1: no term here
    padded[:, :width] = counts
    leaves, levels = segment_trees(padded)
    p = _shares(np.maximum(leaves, 0), totals)
    real = leaves >= 0
    out = []
    for a, others in pairs:
        at, x, y, times = walk(levels, a, others)
        pa_, pb = p[a][x], p[others[at], y]
        f = (pa_ - pb) ** 2 // (pa_ + pb) * times * real[x]
        total = np.zeros(len(others), np.int64)
        np.add.at(total, at, f)
        out.append(total)
    return out


def _walk_block(key: tuple, t: pa.Table, chunk: int) -> pa.Table:
    """One block of two chunks of sources: (lang, a, b, value) for the pairs
    a < b between the chunks (within the chunk, if they are one)."""
    lang, _, ca, cb = (k.as_py() for k in key)
    source, place, n, total, width = (t.column(c).to_numpy() for c in ("no", "place", "n", "total", "width"))
    marks = place < 0                                   # one row per source, whether it has counts here or not
    order = np.argsort(source[marks])
    ids = source[marks][order]
    counts = np.zeros((len(ids), int(width[0])), np.int64)
    counts[np.searchsorted(ids, source[~marks]), place[~marks]] = n[~marks]
    pairs = []
    for a in np.flatnonzero(ids // chunk == ca):
        others = np.flatnonzero((ids // chunk == cb) & (ids > ids[a]))
        if len(others):
            pairs.append((int(a), others))
    if width[0]:
        values = pair_prices(counts, int(width[0]), [int(x) for x in total[marks][order]], pairs)
    else:
        values = [np.zeros(len(o), np.int64) for _, o in pairs]
    empty = [np.zeros(0, np.int64)]
    a = np.concatenate([np.full(len(o), ids[i]) for i, o in pairs] or empty)
    b = np.concatenate([ids[o] for _, o in pairs] or empty)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                     "value": pa.array(np.concatenate(values or empty), pa.int64())})


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
                     block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part 'pair': each other source of the language, by how far the two
    groups' term shares lie apart, all ranks.  Part 'term': the kept terms
    that the group uses more than its language does, ranks to ``top_terms``.
    ``block`` (a power of two) and ``chunk`` size the tasks, not the result.

    Defined results: NULL lang, source and text are ''; a group without kept
    terms has counts of 0; a language without kept terms has pairs of value 0
    and no terms; a language with one source has no pairs; equal values rank
    by item (UTF-8); rows that repeat count each; other columns are ignored;
    an empty table gives no rows.
    """
    counts = materialize(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(
        F.col("docs") >= min_docs).select("lang", "term", "n")
    terms = materialize(numbered_terms(kept), "terms")
    cells = counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "place")
    cells = materialize(cells, "cells")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = docs.select(*_names()).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    no = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    groups = materialize(groups.select(
        "lang", "source", no.cast("bigint").alias("no"), zero("v").alias("v"),
        (zero("own") + SMOOTH * zero("v")).alias("total"), (zero("lang_total") + SMOOTH * zero("v")).alias("lang_total")), "groups")

    # each source's counts in each block, with one row that stands for the source itself
    here = cells.join(groups.select("lang", "source", "no", "v", "total"), ["lang", "source"]).select(
        "lang", F.floor(F.col("place") / block).alias("block"), "no", (F.col("place") % block).alias("place"), "n", "v", "total")
    last = F.greatest(F.floor((F.col("v") - 1) / block), F.lit(0))
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"), "no",
                          F.lit(-1).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("n"), "v", "total")
    chunks = groups.groupBy("lang").agg(F.floor(F.max("no") / chunk).alias("last"))
    own = F.floor(F.col("no") / chunk)
    x = here.unionByName(marks).join(chunks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    x = x.select("lang", "block", F.least(own, "other").alias("ca"), F.greatest(own, "other").alias("cb"), "no", "place", "n", "total",
                 F.least(F.col("v") - F.col("block") * block, F.lit(block)).cast("bigint").alias("width"))
    walked = x.groupBy("lang", "block", "ca", "cb").applyInArrow(
        lambda key, t: _walk_block(key, t, chunk), "lang string, a bigint, b bigint, value bigint")
    both = materialize(walked.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair-values")
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda c, as_: groups.select("lang", F.col("no").alias(c), F.col("source").alias(as_))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    over = cells.join(groups.drop("no", "v"), ["lang", "source"]).withColumns(
        {"p": share("n", "total"), "q": share("lang_n", "lang_total")}).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price("p", "q").alias("value"))
    return ranked(pairs).unionByName(ranked(over).filter(F.col("rank") <= top_terms))
