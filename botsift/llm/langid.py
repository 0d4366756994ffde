"""Language identification of pages by Bayesian evidence fusion.

Four pieces of evidence are combined as log probabilities per language:

* the text: hashed character trigrams under a multinomial model fitted on a
  bounded sample of labelled documents (``SAMPLE_PER_LANG`` per language),
  tempered to at most ``EFFECTIVE_GRAMS`` independent observations, as
  neighbouring trigrams say nearly the same;
* the language that the markup declares: P(declared | language), counted
  over all pages and smoothed by how often it is declared at all;
* the host: a prior smoothed level by level, host over domain over address
  suffix over all pages, from grouped counts of all pages;
* the address suffix is a level of that prior, itself smoothed towards the
  languages of its country where the suffix is a country's.

Counts leave out the page itself.  They are aggregates with map-side combine
over small columns, so a host with a third of all pages is just a large sum.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botsift.session import materialize

SAMPLE_PER_LANG = 2000   # labelled documents per language that the text model is fitted on (whole texts)
BINS = 8192              # trigram bins
EFFECTIVE_GRAMS = 60     # independent observations that a long text counts as
KAPPA = 8.0              # pages that a level's parent counts as
DECLARED_ALPHA = 20.0    # pages that the overall share of a declared language counts as

# Languages of countries with a suffix of their own (ISO codes, fixed values).
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es",
           "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt",
           "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv", "tr": "tr"}

_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,8})", re.I)


def visible_text(page: str) -> str:
    return html.unescape(_TAG.sub(" ", _DROP.sub(" ", page)))


def trigram_bins(text: str, bins: int = BINS) -> np.ndarray:
    """Bin of every character trigram of the lower-cased text."""
    c = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % bins


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    loglik: np.ndarray   # languages x bins

    def score(self, text: str) -> tuple[int, np.ndarray]:
        """Number of trigrams and the tempered log likelihood per language."""
        b = trigram_bins(text, self.loglik.shape[1])
        if not len(b):
            return 0, np.zeros(len(self.languages))
        ll = self.loglik[:, b].sum(axis=1)
        return len(b), ll * min(1.0, EFFECTIVE_GRAMS / len(b))


def fit_text_model(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, bins: int = BINS) -> TextModel:
    """Trigram model of every language in ``docs`` (doc_id, lang, text).

    The sample is the ``per_lang`` documents of each language with the
    smallest hash.  Only hashes below a bound that the language's number of
    documents sets are ranked, so a frequent language is never sorted whole.
    The driver gets one count per language and bin.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", F.lower("lang").alias("_lang"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    n = materialize(known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    near = known.join(n, "_lang").filter(F.col("h") < F.lit(2.0 * per_lang * (1 << 40)) / F.col("n") + F.lit(1.0))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("h", "doc_id"))
    ids = near.withColumn("rank", rank).filter(F.col("rank") <= per_lang).select("doc_id", "_lang")
    ids = materialize(ids, "language-sample")
    sample = docs.select("doc_id", "text").join(ids, "doc_id").select("_lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                n = np.bincount(trigram_bins(text.as_py() or "", bins), minlength=bins)
                counts[lang.as_py()] = counts.get(lang.as_py(), 0) + n
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bin": pa.array(at, pa.int32()),
                                              "n": pa.array(n[at], pa.int64())})

    rows = sample.mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    n = np.zeros((len(langs), bins))
    for r in rows:
        n[langs.index(r["lang"]), r["bin"]] = r["n"]
    p = (n + 0.5) / (n + 0.5).sum(axis=1, keepdims=True) if langs else n
    return TextModel(langs, np.log(p) if langs else p)


def text_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared, n_grams, text_lang (index of the
    most likely language, NULL without text) and loglik."""
    schema = "page_id bigint, url string, declared string, n_grams bigint, text_lang int, loglik array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, grams, best, ll = [], [], [], []
            for page in batch.column("html"):
                page = page.as_py() or ""
                m = _DECLARED.search(page)
                declared.append(m[1].lower() if m else None)
                n, x = model.score(visible_text(page))
                grams.append(n)
                best.append(int(np.argmax(x)) if n and len(x) else None)
                ll.append(x - x.max() if len(x) else x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(declared, pa.string()), pa.array(grams, pa.int64()),
                 pa.array(best, pa.int32()), pa.array(ll, pa.list_(pa.float64()))],
                names=["page_id", "url", "declared", "n_grams", "text_lang", "loglik"])

    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    labels = F.split("host", r"\.")
    return p.withColumn("host", F.coalesce(host, F.lit(""))).withColumns({
        "suffix": F.element_at(labels, -1),
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")}).drop("url")


def _counts(p: DataFrame, key: str, n: int) -> DataFrame:
    """key -> pages with text, per language."""
    return p.filter("text_lang IS NOT NULL").groupBy(key).agg(
        F.array(*[F.count(F.when(F.col("text_lang") == i, 1)) for i in range(n)]).alias(f"{key}_n"))


def fuse(pages: DataFrame, model: TextModel) -> DataFrame:
    """Per page: page_id, lang, confidence, text_lang, declared, host, n_grams.

    Defined results: without text the other evidence decides; a NULL or
    unreadable address has no host evidence; a NULL page_id is carried; rows
    that repeat are pages of their own; without any labelled document there
    are no languages and lang is NULL.  Other columns are ignored.
    """
    langs, n = model.languages, len(model.languages)
    p = materialize(text_evidence(pages, model), "text-evidence")
    if not langs:
        return p.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"),
                        F.lit(None).cast("string").alias("text_lang"), "declared", "host", "n_grams")
    total = p.agg(F.array(*[F.count(F.when(F.col("text_lang") == i, 1)) for i in range(n)])).first()[0]

    j = p
    for key in ("host", "domain", "suffix"):
        j = j.join(_counts(p.filter("host <> ''"), key, n), key, "left")
    declared = p.filter("text_lang IS NOT NULL AND declared IS NOT NULL").groupBy("declared").agg(
        F.array(*[F.count(F.when(F.col("text_lang") == i, 1)) for i in range(n)]).alias("declared_n"))
    j = j.join(declared, "declared", "left")

    own = [(F.col("text_lang") == i) for i in range(n)]
    own = [F.when(F.coalesce(o, F.lit(False)), 1.0).otherwise(0.0) for o in own]

    def count(key: str, i: int) -> Column:
        return F.greatest(F.coalesce(F.col(f"{key}_n")[i].cast("double"), F.lit(0.0)) - own[i], F.lit(0.0))

    def level(key: str, parent: list[Column], weight: float = KAPPA) -> list[Column]:
        """(own pages + weight * parent) / (pages + weight)"""
        c = [count(key, i) for i in range(n)]
        return [(c[i] + weight * parent[i]) / (sum(c) + weight) for i in range(n)]

    names = lambda x: [f"{x}{i}" for i in range(n)]
    put = lambda df, x, cols: df.withColumns(dict(zip(names(x), cols)))
    base = [(t + 1.0) / (sum(total) + n) for t in total]
    country = F.create_map(*[F.lit(x) for kv in COUNTRY.items() for x in kv])[F.col("suffix")]
    # a country's suffix counts as KAPPA pages of its language, if that is one of ours
    known = F.coalesce(country.isin(langs), F.lit(False))
    j = put(j, "c", [F.when(known, 0.5 * base[i] + 0.5 * F.when(country == langs[i], 1.0).otherwise(0.0)).otherwise(base[i])
                     for i in range(n)])
    for key, prior, parent in (("suffix", "s", "c"), ("domain", "d", "s"), ("host", "h", "d")):
        j = put(j, prior, level(key, [F.col(x) for x in names(parent)]))
    d = [count("declared", i) for i in range(n)]
    share = (sum(d) + 1.0) / (float(sum(total)) + 2.0)  # how often this language is declared at all
    given = [F.when(F.col("declared").isNull(), 0.0).otherwise(F.log(
        (d[i] + DECLARED_ALPHA * share) / (float(total[i]) + DECLARED_ALPHA))) for i in range(n)]
    j = put(j, "z", [F.col("loglik")[i] + F.log(F.col(f"h{i}")) + given[i] for i in range(n)])
    z = F.array(*[F.col(x) for x in names("z")])
    j = j.withColumn("z", z).withColumn("top", F.array_max("z"))
    weight = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name = F.array(*[F.lit(x) for x in langs])
    return j.select("page_id", F.get(name, F.array_position("z", F.col("top")).cast("int") - 1).alias("lang"),
                    F.round(1.0 / weight, 6).alias("confidence"), F.get(name, F.col("text_lang")).alias("text_lang"),
                    "declared", "host", "n_grams")
