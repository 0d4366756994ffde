"""Benchmark decontamination over a distributed positional inverted index.

The index has one posting (token, d, pos) per occurrence of a token in the
corpus, restricted by a semi-join to the tokens that the benchmark uses (no
other posting can ever be asked for).  It is a plain table: built in one
pass over the texts, without a shuffle, and written to the shared folder.

A search for exact phrases goes from rare to frequent:
  1. token counts come from the index itself;
  2. every benchmark window picks its two rarest terms; windows with a term
     that the corpus lacks are out;
  3. the postings of the rarest terms, shifted by the term's offset in the
     passage, give the places ("alignments") where the passage could lie;
     they are intersected with the shifted postings of the second term;
  4. the alignments left are few; those of a document and a passage meet the
     document's words, where each window is compared in full, and hit words
     and items are counted from the rows that come of it.

Only DataFrame functions are used.  Postings of a very frequent token are
spread by the scan that reads them; they are only ever joined to the small
table of selected terms, whose size the planner knows as it has been written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botsift.llm.bitmap import maybe_in
from botsift.llm.words import alnum_words
from botsift.session import materialize

WINDOW = 10        # words of a phrase that count as a leak
NEAR_TERMS = 3     # rarest terms of a passage that a proximity match needs
NEAR_SLOP = 20     # ... within so many words of the rarest
NO_ID = -(2**63)   # sign of the names of documents without an id


def _text_name() -> Column:
    return F.xxhash64("text")


def _key() -> Column:
    """A document's name in the index: its id, or without one a negative
    number from its text.  Names may meet; occurrences are found on the
    words of each text, so that only adds alignments to look at."""
    return F.coalesce(F.col("doc_id").cast("bigint"), _text_name().bitwiseOR(F.lit(NO_ID)))


def passages(items: DataFrame) -> DataFrame:
    """Distinct word sequences of the benchmark: pid, words, item_ids (sorted
    strings).  Items without words are out; rows with a NULL item_id still
    count as passages but are not listed."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("words"))
    g = w.filter(F.size("words") > 0).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return materialize(g.select(F.monotonically_increasing_id().alias("pid"), "words", "item_ids"), "passages")


def build_index(docs: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Postings (token, d, pos) of every document, whole texts; ``tokens``
    (column token) restricts the index to the terms that can be searched."""
    # explode_outer: a plain explode adds a size(...) > 0 filter that would split every text twice
    p = docs.select(_key().alias("d"), F.posexplode_outer(alnum_words(F.col("text"))).alias("pos", "token"))
    if tokens is not None:
        p = p.join(tokens.select("token").distinct(), "token", "left_semi")
    return p.filter(F.col("token").isNotNull()).select("token", "d", "pos")


def _term_counts(index: DataFrame, passages_: DataFrame) -> DataFrame:
    """pid, words, terms: array of (off, n, token) in passage order, n the
    number of postings of the token (0 if the corpus lacks it)."""
    n = index.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    t = passages_.select("pid", F.posexplode("words").alias("off", "token"))
    t = t.join(n, "token", "left").groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct("off", F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("terms"))
    return materialize(t, "terms")


def _rare_pairs(terms: DataFrame, window: int) -> DataFrame:
    """Distinct (pair, pid, off1, token1, off2, token2): for every window that
    can occur its rarest term and its rarest other term (NULL if it has none)."""
    width = F.least(F.size("terms"), F.lit(window))
    w = terms.select("pid", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("terms") - width), lambda s: F.slice("terms", s + 1, width))).alias("win"))
    w = w.filter(~F.exists("win", lambda t: t["n"] == 0))
    by_count = lambda t: F.struct(t["n"].alias("n"), t["token"].alias("token"), t["off"].alias("off"))
    w = w.select("pid", "win", F.array_min(F.transform("win", by_count)).alias("one"))
    w = w.select("pid", "one", F.array_min(F.transform(
        F.filter("win", lambda t: t["token"] != F.col("one.token")), by_count)).alias("two"))
    p = w.select("pid", F.col("one.off").alias("off1"), F.col("one.token").alias("token1"),
                 F.col("two.off").alias("off2"), F.col("two.token").alias("token2")).distinct()
    return materialize(p.select(F.monotonically_increasing_id().alias("pair"), "*"), "rare-pairs")


def alignments(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (d, pid, diag): documents and word positions at which a
    passage's first word would lie, from intersected rare postings."""
    pairs = _rare_pairs(terms, window)

    def shifted(i: int) -> DataFrame:
        sel = pairs.filter(F.col(f"token{i}").isNotNull()).select(
            "pair", "pid", F.col(f"off{i}").alias("off"), F.col(f"token{i}").alias("token"))
        return index.join(sel, "token").select("pair", "pid", "d", (F.col("pos") - F.col("off")).alias("diag"))

    one = shifted(1)
    alone = one.join(pairs.filter(F.col("token2").isNull()).select("pair"), "pair", "left_semi")
    both = one.join(shifted(2), ["pair", "d", "diag"], "left_semi")
    return alone.unionByName(both).select("d", "pid", "diag").distinct()


def near_passages(index: DataFrame, terms: DataFrame, k: int = NEAR_TERMS, slop: int = NEAR_SLOP) -> DataFrame:
    """Proximity matches (d, pid): documents in which the k rarest distinct
    terms of a passage (all, if it has fewer) occur within ``slop`` words of
    an occurrence of the rarest one, in any order.

    Positions are matched through buckets of ``slop`` words, so a posting
    meets only those at most two buckets away, however often a term occurs.
    """
    by_count = lambda t: F.struct(t["n"].alias("n"), t["token"].alias("token"))
    sel = terms.select("pid", F.slice(F.array_sort(F.array_distinct(F.transform("terms", by_count))), 1, k).alias("r"))
    sel = sel.filter(~F.exists("r", lambda t: t["n"] == 0)).select("pid", F.size("r").alias("k"), F.posexplode("r").alias("i", "t"))
    sel = materialize(sel.select("pid", "k", "i", F.col("t.token").alias("token")), "near-terms")
    p = index.join(sel, "token").select("pid", "k", "i", "d", "pos", F.floor(F.col("pos") / slop).alias("bucket"))
    first = p.filter("i = 0").select("pid", "k", "d", F.col("pos").alias("p0"), F.explode(
        F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    other = p.filter("i > 0").select("pid", "i", "d", "pos", "bucket")
    met = first.join(other, ["pid", "d", "bucket"]).filter(F.abs(F.col("pos") - F.col("p0")) <= slop)
    met = met.groupBy("pid", "k", "d", "p0").agg(F.countDistinct("i").alias("n")).filter("n = k - 1")
    alone = first.filter("k = 1").select("pid", "d")
    return met.select("pid", "d").unionByName(alone).distinct()


def _occurrences(docs: DataFrame, found: DataFrame, pas: DataFrame, window: int) -> DataFrame:
    """Per text and passage with an occurrence: d, t (name of the text),
    item_ids, hit (positions of the words inside any occurrence).

    Only texts with an alignment are shuffled.  A row is one document and one
    passage, with the passage's words once and a position per alignment, so
    it is bounded by the document, however often a passage occurs in it.
    """
    al = materialize(found.groupBy("d", "pid").agg(F.collect_list("diag").alias("diags")), "alignments")
    texts = maybe_in(docs.select(_key().alias("d"), _text_name().alias("t"), "text"), "d", al.select("d"))
    x = al.join(pas, "pid").join(texts.select("d", "t", alnum_words(F.col("text")).alias("w")), "d")
    width = F.least(F.size("words"), F.lit(window))

    def inside(diag: Column) -> Column:
        """Positions of the words of all windows that occur in full here."""
        at = F.filter(F.sequence(F.lit(0), F.size("words") - width), lambda s: (diag + s >= 0) & (
            F.slice("w", diag + s + 1, width) == F.slice("words", s + 1, width)))
        return F.flatten(F.transform(at, lambda s: F.sequence(diag + s, diag + s + width - 1)))

    hit = F.array_distinct(F.flatten(F.transform("diags", lambda g: F.array_distinct(inside(g)))))
    return x.select("d", "t", "item_ids", hit.alias("hit")).filter(F.size("hit") > 0)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: bool = True) -> DataFrame:
    """One row per document row: ``_row`` (the input row as a struct), doc_id,
    n_words, n_hit, n_items, items_sha256, contaminated, near_items.

    A leak is ``window`` consecutive words of an item, or a whole shorter
    item.  ``n_hit`` counts document words inside any occurrence; items are
    listed by id, sorted as strings; ``near_items`` counts items with a
    proximity match (NULL with ``near=False``).

    Defined results: a NULL or wordless text has no words and no hits; a row
    without doc_id is reported like any other; rows that share a doc_id are
    judged each by its own text (proximity: together); an empty benchmark
    hits nothing.  Other columns are carried in ``_row`` and never read.
    """
    pas = passages(items)
    vocabulary = materialize(pas.select(F.explode("words").alias("token")).distinct(), "vocabulary")
    index = materialize(build_index(docs, vocabulary), "postings")
    terms = _term_counts(index, pas)
    found = materialize(_occurrences(docs, alignments(index, terms, window), pas, window), "occurrences")
    hits = found.select("d", "t", F.explode("hit").alias("pos")).distinct().groupBy("d", "t").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = found.select("d", "t", F.explode("item_ids").alias("id")).groupBy("d", "t").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _key().alias("d"), _text_name().alias("t"),
                       F.size(alnum_words(F.col("text"))).cast("bigint").alias("n_words"))
    rows = rows.join(hits.join(ids, ["d", "t"], "left"), ["d", "t"], "left")
    if near:
        close = near_passages(index, terms).join(pas.select("pid", F.explode("item_ids").alias("item_id")), "pid")
        rows = rows.join(close.groupBy("d").agg(F.countDistinct("item_id").alias("near_items")), "d", "left")
    else:
        rows = rows.withColumn("near_items", F.lit(0))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return rows.select(
        "_row", F.col("_row")["doc_id"].alias("doc_id"), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("near_items", F.lit(0)).cast("bigint").alias("near_items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window."""
    return contamination(docs, items, window, near=False).filter(~F.col("contaminated")).select("_row.*")
