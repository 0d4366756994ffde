"""Quality rules: word statistics and tokeniser fertility.

Every text is measured in one pass.  Besides the base counts, public
vocabularies say how a tokeniser takes the text:

* characters per token, under a byte-fallback vocabulary and under a
  byte-level one (few characters per token: not the text it claims to be);
* byte-fallback share: tokens that are raw bytes, as the vocabulary has no
  piece for them (high: binary junk, broken encodings);
* token entropy, in bits per token, as a share of what that many different
  tokens would have, ENTROPY_TOKENS at most (low: the same few tokens again).

A document is rejected if a measure leaves the band of its language, or of
its script if the language has no band.  Within these fixed bands, both
characters per token are held to fences that the table itself sets: quartiles
over all its texts per language, or per script for languages of few texts.

Words are tokenised one by one,
which a vocabulary that never merges across white space does anyway, so each
worker remembers the tokens of the words it has met.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from botsift.session import materialize

VOCABULARIES = "/opt/tokenizers"           # folder of the public vocabulary files
PIECES = "piece_bpe_32k.model"             # byte-fallback vocabulary
BYTE_LEVEL = "byte_bpe_multi_50k.tiktoken"  # byte-level vocabulary
CACHE_WORDS = 150_000   # tokenised words a worker remembers (a speed setting)

# Fixed value: the pattern that the byte-level vocabulary splits texts by.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ENTROPY_TOKENS = 1024  # longer texts repeat tokens anyway
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
            "n_repeat_words bigint, script string, n_pieces bigint, n_bytes bigint, n_byte_level bigint, entropy double")

# Bands: characters per piece (from, to), characters per byte-level token (from, to), byte-fallback share
# (at most), relative entropy (at least).  By language where one is known, else by script.
BANDS = {
    "en": (1.4, 8.0, 1.7, 9.0, 0.15, 0.60),
    "de": (1.4, 8.0, 1.7, 9.0, 0.15, 0.60),
    "fr": (1.4, 8.0, 1.7, 9.0, 0.15, 0.60),
    "es": (1.4, 8.0, 1.7, 9.0, 0.15, 0.60),
    "latin": (1.3, 9.0, 1.3, 10.0, 0.20, 0.40),
    "cyrillic": (1.2, 8.0, 1.0, 9.0, 0.20, 0.40),
    "greek": (0.8, 6.0, 0.6, 7.0, 0.30, 0.40),
    "han": (0.4, 3.0, 0.3, 3.0, 0.75, 0.35),
    "other": (0.3, 10.0, 0.2, 12.0, 0.90, 0.30),
}

# Fences: MARGIN times the distance of the quartiles beyond them, and never nearer to the median than NEAREST percent
# of it.  A group of fewer than MIN_TEXTS texts has none.
MARGIN = 6
NEAREST = (15, 25)  # below, above
MIN_TEXTS = 100

# Letters that tell a script (fixed Unicode ranges, ends included).
_SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)),
    "cyrillic": ((0x400, 0x4FF),),
    "greek": ((0x370, 0x3FF),),
    "han": ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}


def script_of(text: str) -> str:
    """The script with most letters in the text, 'other' without any."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    n = {k: sum(int(((c >= a) & (c <= b)).sum()) for a, b in v) for k, v in _SCRIPTS.items()}
    best = max(n, key=lambda k: n[k])
    return best if n[best] else "other"


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside ``width``-word windows that occur twice or more.

    Windows get exact names by doubling: the names of two neighbouring
    half-windows, paired, name the whole (``width`` is a power of two).
    """
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    half = 1
    while half < width:
        pair = names[:-half] * (names.max() + 1) + names[half:]
        names = np.unique(pair, return_inverse=True)[1].reshape(-1)
        half *= 2
    again = np.bincount(names)[names] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class _Tokens:
    """The tokens of words under both vocabularies.

    The first CACHE_WORDS words met are remembered as rows of flat arrays;
    later ones are tokenised as they come, all of a text at once.
    """

    def __init__(self, pieces: bytes, ranks: bytes):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes_from = next(i for i in range(self.pieces.get_piece_size()) if self.pieces.is_byte(i))
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.level = tiktoken.Encoding("byte-level", pat_str=WORD_PATTERN, mergeable_ranks=table, special_tokens={})
        self.row: dict[bytes, int] = {}
        self.start, self.n, self.n_level = (np.zeros(CACHE_WORDS, dtype=np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(4 * CACHE_WORDS, dtype=np.int32), 0

    def _tokenise(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        ids, level = [], 0
        for i in range(0, len(words), 5000):
            text = b" ".join(words[i:i + 5000]).decode("utf-8", "replace")
            ids += self.pieces.encode(text)
            level += len(self.level.encode_ordinary(" " + text))
        return np.array(ids, dtype=np.int32), level

    def _remember(self, words: set[bytes]) -> None:
        for word in words:
            row = len(self.row)
            if row >= CACHE_WORDS:
                return
            ids, level = self._tokenise([word])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), dtype=np.int32)])
            self.ids[self.used:self.used + len(ids)] = ids
            self.start[row], self.n[row], self.n_level[row] = self.used, len(ids), level
            self.used += len(ids)
            self.row[word] = row

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Pieces of the words, how often each row of them counts, and the
        number of byte-level tokens."""
        rows = np.fromiter(map(self.row.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if (rows < 0).any() and len(self.row) < CACHE_WORDS:
            self._remember({words[i] for i in np.flatnonzero(rows < 0)})
            rows = np.fromiter(map(self.row.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        more, level = self._tokenise([words[i] for i in np.flatnonzero(rows < 0)])
        u, times = np.unique(rows[rows >= 0], return_counts=True)
        n = self.n[u]
        at = np.arange(n.sum()) + np.repeat(self.start[u] - (np.cumsum(n) - n), n)
        return (np.concatenate([self.ids[at], more]), np.concatenate([np.repeat(times, n), np.ones(len(more), dtype=np.int64)]),
                level + int((self.n_level[u] * times).sum()))


def fertility(words: list[bytes], tokens: _Tokens) -> tuple[int, int, int, float]:
    """Pieces, byte-fallback pieces, byte-level tokens, entropy of the pieces."""
    if not words:
        return 0, 0, 0, 0.0
    ids, times, level = tokens.of(words)
    fallback = (ids >= tokens.bytes_from) & (ids < tokens.bytes_from + 256)
    per_id = np.bincount(ids, weights=times)
    p = per_id[per_id > 0]
    n = p.sum()
    entropy = float(np.log2(n) - (p * np.log2(p)).sum() / n) if n else 0.0
    return int(n), int(times[fallback].sum()), level, entropy


def measure(docs: DataFrame, vocabularies: str = VOCABULARIES, keep: list[str] | None = None) -> DataFrame:
    """``_row`` (the columns ``keep`` of the input row, all by default), lang
    and the measures (MEASURES) of every whole text; a NULL text has no words."""
    with open(f"{vocabularies}/{PIECES}", "rb") as f, open(f"{vocabularies}/{BYTE_LEVEL}", "rb") as g:
        pieces, ranks = f.read(), g.read()  # fixed files of 0.5 and 0.8 MB
    names = [x.split(" ")[0] for x in MEASURES.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.int64()] * 3 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(pieces, ranks)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                words = text.encode("utf-8", "replace").split()
                out.append((
                    len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
                    repeated_lines(text), repeated_words(words), script_of(text), *fertility(words, tokens)))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("lang"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["_row", "lang", *names])

    d = docs.select(F.struct(*(keep or docs.columns)).alias("_row"),
                    (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"),
                    F.col("text").cast("string").alias("text"))
    schema = T.StructType([d.schema["_row"], d.schema["lang"], *T._parse_datatype_string(MEASURES).fields])
    return d.mapInArrow(run, schema)


def _hundredths(chars: str, tokens: str) -> Column:
    return F.floor(F.try_divide(100 * F.col(chars), F.col(tokens))).cast("bigint")


def fences(measured: DataFrame, margin: int = MARGIN, min_texts: int = MIN_TEXTS) -> DataFrame:
    """Fences of characters per token: kind ('lang' or 'script'), name, and
    ``of``: lowest and highest hundredth of both measures, four numbers.

    All texts that pass the base rules count; texts equal in language, script
    and counts count once, so that copies do not set the fences.  The numbers
    of texts per hundredth give the quartiles, exactly and in any order.
    """
    texts = measured.filter(~_base_failed()).select(
        F.lower("lang").alias("lang"), "script", "word_chars", "n_pieces", "n_byte_level").distinct()
    groups = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("lang", "script")])
    values = F.array(*[F.named_struct(F.lit("measure"), F.lit(i), F.lit("at"), _hundredths("word_chars", c))
                       for i, c in enumerate(("n_pieces", "n_byte_level"))])
    rows = texts.select(F.explode(groups).alias("g"), values.alias("v")).select("g.*", F.inline("v"))
    n = rows.filter("name IS NOT NULL AND at IS NOT NULL").groupBy("kind", "name", "measure", "at").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("kind", "name", "measure")  # as many rows as a measure has hundredths
    n = n.withColumn("upto", F.sum("n").over(whole.orderBy("at"))).withColumn("all", F.sum("n").over(whole))
    q = [F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("at"))).alias(f"q{k}") for k in (1, 2, 3)]
    g = n.groupBy("kind", "name", "measure").agg(F.max("all").alias("all"), *q).filter(F.col("all") >= min_texts)
    reach = margin * (F.col("q3") - F.col("q1"))
    lo = F.least(F.col("q1") - reach, F.floor((100 - NEAREST[0]) * F.col("q2") / 100))
    hi = F.greatest(F.col("q3") + reach, F.ceil((100 + NEAREST[1]) * F.col("q2") / 100))
    ends = F.sort_array(F.collect_list(F.struct("measure", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))))  # two
    return g.groupBy("kind", "name").agg(ends.alias("e")).select(
        "kind", "name", F.flatten(F.transform("e", lambda x: F.array(x["lo"], x["hi"]))).alias("of"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge(measured: DataFrame, bands: dict[str, tuple] = BANDS, fence: DataFrame | None = None) -> DataFrame:
    """Adds chars_per_piece, chars_per_byte_level, byte_share, rel_entropy,
    base_failed and kept to the measures.  A text without words fails the
    base rules; unknown languages and scripts use the bands of the script."""
    table = F.create_map(*[x for k, v in bands.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])
    band = F.coalesce(F.try_element_at(table, F.lower("lang")), F.try_element_at(table, F.col("script")))
    m = measured.withColumns({
        "chars_per_piece": F.try_divide(F.col("word_chars"), F.col("n_pieces")),
        "chars_per_byte_level": F.try_divide(F.col("word_chars"), F.col("n_byte_level")),
        "byte_share": F.try_divide(F.col("n_bytes"), F.col("n_pieces")),
        "rel_entropy": F.try_divide(F.col("entropy"), F.log2(F.least(F.col("n_pieces"), F.lit(ENTROPY_TOKENS)).cast("double"))),
        "_band": band})
    b = F.col("_band")
    within = (F.col("chars_per_piece").between(b[0], b[1]) & F.col("chars_per_byte_level").between(b[2], b[3])
              & (F.col("byte_share") <= b[4]) & (F.col("rel_entropy") >= b[5]))
    if fence is not None:
        for kind, key in (("lang", F.lower("lang")), ("script", F.col("script"))):
            f = fence.filter(F.col("kind") == kind).select(F.col("name").alias(f"_{kind}"), F.col("of").alias(f"_of_{kind}"))
            m = m.join(f, key == F.col(f"_{kind}"), "left")
        f = F.coalesce("_of_lang", "_of_script")
        inside = (_hundredths("word_chars", "n_pieces").between(f[0], f[1])
                  & _hundredths("word_chars", "n_byte_level").between(f[2], f[3]))
        within = within & F.coalesce(inside, F.lit(True))
    return m.withColumn("base_failed", _base_failed()).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).drop("_band", "_lang", "_script", "_of_lang", "_of_script")


def quality(docs: DataFrame, vocabularies: str = VOCABULARIES, bands: dict[str, tuple] = BANDS,
            keep: list[str] | None = None, margin: int = MARGIN, min_texts: int = MIN_TEXTS) -> DataFrame:
    """One row per document row: ``_row``, the measures and the verdict.

    Texts are measured once, into a table in the shared folder; the fences
    are set from all of it.  Defined results: NULL, empty and wordless texts
    have zero counts and are not kept; ids may be NULL or repeat, every row
    is judged by itself; a NULL or unknown lang falls back to the script; a
    table without lang too.
    """
    measured = materialize(measure(docs, vocabularies, keep), "quality-measures")
    return judge(measured, bands, materialize(fences(measured, margin, min_texts), "quality-fences"))


def drop_low_quality(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    return quality(docs, **params).filter("kept").select("_row.*")
