"""Toxicity scores by a convolutional text classifier, trained in numpy.

A word is the sum of the embeddings of its hashed features (the word, its
beginnings and end, its shape).  Filters of several widths slide over a
text's words, each filter's largest answer anywhere in the text is kept, and
a logistic layer turns those maxima into a score.  The classifier learns from
every labelled row that is not held out: shards of the rows descend in
parallel and their parameters are averaged after each round.  Scoring is a
map over whole texts of any length, in pieces that overlap by the widest
filter.

The score is calibrated, so 0.5 is the cut for all texts.  Thresholds of
single languages come on top: they are found on labelled rows that the
filters have not seen, and never change a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botsift.llm.bitmap import maybe_in
from botsift.session import materialize

SAMPLE_POSITIVE = 1500    # rows of either class in ``labelled_sample``, at most
SAMPLE_NEGATIVE = 3000
SAMPLE_CHARS = 200_000    # longer texts are not in ``labelled_sample``
FOLDS, HELD = 5, 0        # rows with crc32(doc_id) mod FOLDS = HELD are never learnt from
CALIBRATION = 4           # every so many-th labelled id calibrates and is kept from the filters
BINS = 1 << 16            # embeddings
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 16              # per width
EPOCHS = 8                # passes over the labelled rows, at most
VISITS = 27_000           # from so many rows on, one pass is enough
ROUNDS = 4                # of parallel descent, at least
SHARD_ROWS = 16_384       # rows that one task learns from
BATCH = 16
RATE = 0.08               # step size (Adagrad)
MIN_LANGUAGE = 12         # calibration rows of each class that a language needs for a threshold of its own
CACHE_WORDS = 250_000     # embedded words that a Python worker remembers (a speed setting only)
PIECE_CHARS = 1 << 19     # characters that are split into words at once
PIECE_WORDS = 1 << 16     # words that the filters slide over at once

_SPACE = re.compile(r"[\x20\x09-\x0D]")
_MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
FEATURES = 6
_hash = xxhash.xxh3_64_intdigest


def word_features(word: str) -> list[int]:
    """Hashes of a word's features; a bin is a hash modulo BINS."""
    core = word.strip(_MARKS)
    low = core.lower()
    last = word[-1]
    shape = ("U" if core[:1].isupper() else "l") + ("a" if core.isalpha() else "d") + (
        "." if last in ".!?" else "," if last in _MARKS else "")
    return [_hash("w" + low), _hash("4" + low[:4]), _hash("5" + low[:5]), _hash("6" + low[:6]), _hash("e" + low[-4:]),
            _hash("s" + shape)]


def word_bins(words: list[str]) -> np.ndarray:
    """words x FEATURES bins."""
    h = np.array([h for w in words for h in word_features(w)], np.uint64)
    return (h % np.uint64(BINS)).astype(np.int64).reshape(len(words), FEATURES)


def word_pieces(text: str) -> Iterator[list[str]]:
    """The words of a text, in pieces of about PIECE_CHARS characters."""
    at = 0
    while at < len(text):
        if len(text) - at <= PIECE_CHARS:
            end = len(text)
        else:
            m = _SPACE.search(text, at + PIECE_CHARS)
            end = m.start() if m else len(text)
        if words := [w for w in _SPACE.split(text[at:end]) if w]:
            yield words
        at = max(end, at + 1)


@dataclass
class Network:
    """The trained parameters: embeddings, per width w a (w, DIM, FILTERS)
    kernel and a bias, the output weights, and the calibration (a, b)."""
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0

    def maxima(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Every filter's largest answer over the embedded words x, and where
        it was.  Texts shorter than a filter are padded with zeros."""
        best, at = [], []
        least = max(WIDTHS)
        y = x if len(x) >= least else np.vstack([x, np.zeros((least - len(x), DIM), np.float32)])
        # filters x words, so that a filter's answers lie side by side
        every = np.concatenate([k[j] for k in self.kernels for j in range(len(k))], axis=1).T @ np.ascontiguousarray(y.T)
        row = 0
        for k, b in zip(self.kernels, self.biases):
            n = max(len(x), len(k)) - len(k) + 1
            z = every[row:row + FILTERS, :n].copy()
            for j in range(1, len(k)):
                z += every[row + j * FILTERS:row + (j + 1) * FILTERS, j:j + n]
            row += len(k) * FILTERS
            i = z.argmax(axis=1)
            at.append(i)
            best.append(z[np.arange(len(z)), i] + b)
        return np.maximum(np.concatenate(best), 0), at

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias


class Scorer:
    """Scores texts with a network, remembering embedded words."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.table = np.zeros((1024, DIM), np.float32)

    def embed(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(dict.fromkeys(words))
            start = len(known)
            while len(self.table) < start + len(new):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            self.table[start:start + len(new)] = self.net.embedding[word_bins(new)].sum(axis=1)
            known.update(zip(new, range(start, start + len(new))))
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def margin(self, text: str) -> float:
        pooled, tail = None, []
        for words in word_pieces(text):
            words = tail + words
            best, _ = self.net.maxima(self.embed(words))
            pooled = best if pooled is None else np.maximum(pooled, best)
            tail = words[-(max(WIDTHS) - 1):]
        if pooled is None:
            pooled = np.zeros(len(self.net.out), np.float32)
        return float(self.net.margin(pooled))

    def score(self, text: str) -> float:
        return float(_sigmoid(self.net.scale * self.margin(text) + self.net.shift))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def _presence(docs: list[np.ndarray], bins: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    both = np.zeros((2, BINS))
    for words, t in zip(docs, toxic):
        both[int(t), np.unique(bins[words])] += 1
    return presence_of(both, toxic.mean())


def presence_of(both: np.ndarray, share: float) -> np.ndarray:
    """Per bin, from its counts of rows of either class: how much oftener
    toxic rows have it than their share, in standard deviations, damped and
    bounded."""
    expected = (both[0] + both[1]) * share
    return np.clip((both[1] - expected) / np.sqrt(expected + 1.0) / 4.0, -1.0, 2.0)


class Words:
    """Numbers words and keeps their bins."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bins = np.zeros((1024, FEATURES), np.int64)

    def of(self, text: str) -> np.ndarray:
        """The numbers of a text's words, in order."""
        number, out = self.number, []
        for piece in word_pieces(text):
            if new := [w for w in dict.fromkeys(piece) if w not in number]:
                start = len(number)
                while len(self.bins) < start + len(new):
                    self.bins = np.vstack([self.bins, np.zeros_like(self.bins)])
                self.bins[start:start + len(new)] = word_bins(new)
                number.update(zip(new, range(start, start + len(new))))
            out.append(np.fromiter(map(number.__getitem__, piece), np.int64, len(piece)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def new_network(presence: np.ndarray | None, seed: int = 7) -> Network:
    """The parameters before the first step.  One embedding dimension starts
    as each bin's share among toxic rows, and one filter of width 1 reads it,
    so that the maxima are at telling words from the first step on.  Without
    ``presence`` (one class only) no text tells anything."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.05, (BINS, DIM)).astype(np.float32),
        [rng.normal(0, (2.0 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    if presence is None:
        net.out[:] = 0
        return net
    net.embedding[:, 0] = presence
    for k in net.kernels:
        k[:, 0, 0] = np.eye(len(k), 1)[:, 0] * 1.0
    net.out[::FILTERS] = 0.5
    return net


class Descent:
    """Adagrad on the logistic loss; ``past`` holds every parameter's sum of
    squared gradients, that of the output bias last."""

    def __init__(self, net: Network, past: list[np.ndarray] | None = None):
        self.net = net
        self.params = [net.embedding, *net.kernels, *net.biases, net.out]
        self.past = past or [np.full(p.shape, 0.1, np.float32) for p in [*self.params, np.zeros(1)]]
        self.touched = np.zeros(BINS, bool)

    def _maxima(self, bins: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every filter's largest answer in a text, and where it was."""
        best = at = None
        for start in range(0, max(1, len(words) - max(WIDTHS) + 1), PIECE_WORDS):
            part = words[start:start + PIECE_WORDS + max(WIDTHS) - 1]
            b, i = self.net.maxima(self.net.embedding[bins[part]].sum(axis=1))
            i = np.concatenate(i) + start
            best, at = (b, i) if best is None else (np.maximum(best, b), np.where(b > best, i, at))
        return best, at

    def step(self, bins: np.ndarray, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """One step on a batch of texts, given as numbers of words."""
        net, n, size = self.net, len(WIDTHS), len(docs)
        pooled, at = np.zeros((size, len(net.out)), np.float32), np.zeros((size, len(net.out)), np.int64)
        for d, words in enumerate(docs):
            if len(words):
                pooled[d], at[d] = self._maxima(bins, words)
        g = (weight * (_sigmoid(net.margin(pooled)) - y))
        bias = float(g.sum()) / size
        grads = [None] + [np.zeros_like(p) for p in self.params[1:]]
        grads[-1] += (g[:, None] * pooled).sum(axis=0)
        back = (g[:, None] * net.out * (pooled > 0)).astype(np.float32)
        first = np.concatenate([[0], np.cumsum([len(w) for w in docs])])
        every = np.concatenate(docs)
        rows, steps = [], []
        for i, k in enumerate(net.kernels):
            b = back[:, i * FILTERS:(i + 1) * FILTERS]
            grads[1 + n + i] += b.sum(axis=0)
            for j in range(len(k)):
                pos = at[:, i * FILTERS:(i + 1) * FILTERS] + first[:-1, None] + j
                doc, f = np.nonzero((pos < first[1:, None]) & (b != 0))
                if not len(doc):
                    continue
                r, back_j = bins[every[pos[doc, f]]], b[doc, f][:, None]
                np.add.at(grads[1 + i][j].T, f, net.embedding[r].sum(axis=1) * back_j)
                rows.append(r)
                steps.append(k[j].T[f] * back_j)
        if rows:
            r, step = np.concatenate(rows).ravel(), np.repeat(np.concatenate(steps), FEATURES, axis=0)
            order = np.argsort(r, kind="stable")
            r = r[order]
            starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            g_bins, r = np.add.reduceat(step[order], starts, axis=0) / size, r[starts]
            self.past[0][r] += g_bins * g_bins
            net.embedding[r] -= RATE * g_bins / np.sqrt(self.past[0][r])
            self.touched[r] = True
        for p, h, g_p in zip(self.params[1:], self.past[1:], grads[1:]):
            g_p /= size
            h += g_p * g_p
            p -= RATE * g_p / np.sqrt(h)
        self.past[-1] += bias * bias
        net.out_bias -= RATE * bias / float(self.past[-1][0]) ** 0.5


def train(texts: list[str], toxic: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit embeddings, filters and output layer by Adagrad on the logistic
    loss, both classes weighing the same, on texts in memory."""
    words = Words()
    docs = [words.of(t) for t in texts]
    y = np.array(toxic, np.float64)
    if not 0 < y.sum() < len(y):  # one class only: its share is all there is to learn
        return new_network(None, seed)
    descent = Descent(new_network(_presence(docs, words.bins, y), seed))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            part = order[start:start + BATCH]
            descent.step(words.bins, [docs[d] for d in part], y[part], weight[part])
    return descent.net


def calibrate(net: Network, margins: np.ndarray, toxic: np.ndarray, share: float) -> None:
    """Set scale and shift by a logistic fit of unseen margins, drawn towards
    scale 1; the classes weigh as in the labelled rows (``share`` toxic)."""
    def sums(a: float, b: float, weights: tuple[float, float]) -> list[float]:
        w = np.where(toxic > 0, weights[1], weights[0])
        p = _sigmoid(a * margins + b)
        v = w * p * (1 - p) + 1e-9
        return [(w * (p - toxic) * margins).sum(), (w * (p - toxic)).sum(), (v * margins * margins).sum(), (v * margins).sum(), v.sum()]

    logistic_fit(net, len(toxic), int(toxic.sum()), share, sums)


def logistic_fit(net: Network, n: int, n_toxic: int, share: float, sums: Callable) -> None:
    """Newton steps for scale and shift over ``n`` margins, which only
    ``sums(scale, shift, class weights)`` sees."""
    if not 0 < n_toxic < n:
        net.scale, net.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return
    weights = (1 - share) * n / (n - n_toxic), share * n / n_toxic
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(50):
        ga, gb, haa, hab, hbb = sums(a, b, weights)
        da, db = np.linalg.solve(np.array([[haa + 1.0, hab], [hab, hbb + 1e-6]]), np.array([ga + (a - 1.0), gb]))
        da, db = np.clip([da, db], -1.0, 1.0)  # a full step from afar can overshoot without end
        before, a, b = (a, b), max(a - da, 0.05), b - db
        if abs(a - before[0]) + abs(b - before[1]) < 1e-11:
            break
    net.scale, net.shift = float(a), float(b)


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The cut between two neighbouring scores with the highest F1."""
    order = np.argsort(-scores, kind="stable")
    s, t = scores[order], toxic[order]
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(t) + 1) + t.sum())
    last = np.append(s[1:] < s[:-1], True)  # equal scores fall on one side
    i = int(np.argmax(np.where(last, f1, -1.0)))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


@dataclass
class Model:
    net: Network
    thresholds: dict[str, float]   # per language; others take 0.5


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept from learning (a NULL id is ''
    for this rule)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD


def labelled_sample(docs: DataFrame, labels: DataFrame, positive: int = SAMPLE_POSITIVE, negative: int = SAMPLE_NEGATIVE) -> DataFrame:
    """text, lang, toxic, share (of toxic rows) of at most so many labelled
    rows of either class: those of the smallest hash of their id.  A look at
    the labels by hand; ``fit`` learns from all of them.

    Ids are ranked without their texts, and only below a bound that a class's
    size sets, so no class is ever sorted whole.  An id with labels of both
    kinds counts as toxic; labels other than 0 and 1, rows without id or text
    and held-out rows are left out.
    """
    marks = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    ids = docs.filter((F.col("text").isNotNull()) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id").join(marks, "doc_id")
    ids = materialize(ids.distinct().withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))), "labelled")
    n = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {0: negative, 1: positive}
    near = F.lit(False)
    for t, rows in n.items():
        near = near | ((F.col("toxic") == t) & (F.col("h") <= min(1 << 40, int(2.0 * most[t] / rows * (1 << 40)) + 1)))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("h", "doc_id"))
    ids = ids.filter(near).withColumn("rank", rank).filter(F.when(F.col("toxic") == 1, positive).otherwise(negative) >= F.col("rank"))
    ids = materialize(ids.select("doc_id", "toxic", "h"), "labelled-sample")
    share = n.get(1, 0) / max(sum(n.values()), 1)
    texts = docs.filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).join(ids, "doc_id").groupBy("doc_id").agg(
        F.min(F.struct("text", "lang")).alias("x"), F.first("toxic").alias("toxic"), F.first("h").alias("h"))
    return texts.select("h", "doc_id", "x.text", "x.lang", "toxic", F.lit(share).alias("share"))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, toxic, calibrates: every row of ``docs`` with text
    and a label to learn from, whatever its length.

    An id with labels of both kinds counts as toxic; labels other than 0 and
    1, rows without id or text and held-out rows are left out.  Every
    CALIBRATION-th id calibrates, the others teach the filters.
    """
    marks = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    marks = materialize(marks, "marks")  # its size is known to the planner, so texts move only if ids are many
    docs = maybe_in(docs.filter("text IS NOT NULL"), "doc_id", marks.select("doc_id"))
    x = docs.select(
        "doc_id", F.make_valid_utf8(F.col("text").cast("string")).alias("text"), F.col("lang").cast("string").alias("lang"))
    calibrates = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string"))) % CALIBRATION == 0
    return x.join(marks, "doc_id").withColumn("calibrates", calibrates)


def bin_counts(rows: DataFrame) -> np.ndarray:
    """2 x BINS: in how many rows (text, toxic) of either class a bin occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, both = Words(), np.zeros((2, BINS), np.int64)
        for b in batches:
            for text, t in zip(b.column("text"), b.column("toxic").to_pylist()):
                of = words.of(text.as_py())
                both[t, np.unique(words.bins[np.unique(of)])] += 1
                if len(words.number) > CACHE_WORDS:
                    words.clear()
        at = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[0, at]), pa.array(both[1, at])], names=["bin", "n0", "n1"])

    got = rows.select("text", "toxic").mapInArrow(count, "bin long, n0 long, n1 long").groupBy("bin").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    both = np.zeros((2, BINS))
    both[:, got["bin"].to_numpy()] = got["n0"].to_numpy(), got["n1"].to_numpy()
    return both


def _rows_of(parts: list[np.ndarray]) -> np.ndarray:
    """Parameters other than the embeddings, as rows of DIM numbers."""
    flat = np.concatenate([p.ravel() for p in parts])
    return np.append(flat, np.zeros(-len(flat) % DIM, flat.dtype)).reshape(-1, DIM)


def _shapes_of(rows: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    flat, out, at = rows.ravel(), [], 0
    for p in like:
        out.append(flat[at:at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return out


def _packed(descent: Descent) -> np.ndarray:
    """All parameters and their ``past``, one row of 2 * DIM per bin, then
    those of the other parameters."""
    bias = np.array([descent.net.out_bias], np.float32)
    p = np.vstack([descent.net.embedding, _rows_of([*descent.params[1:], bias])])
    return np.hstack([p, np.vstack([descent.past[0], _rows_of(descent.past[1:])])])


def _unpacked(state: np.ndarray) -> Descent:
    like = Descent(new_network(None))
    shapes = [*like.params[1:], np.zeros(1)]
    *rest, bias = _shapes_of(state[BINS:, :DIM], shapes)
    n = len(WIDTHS)
    net = Network(state[:BINS, :DIM].astype(np.float32), rest[:n], rest[n:2 * n], rest[-1], float(bias[0]))
    return Descent(net, [state[:BINS, DIM:].astype(np.float32), *_shapes_of(state[BINS:, DIM:], shapes)])


def _descend(rows: DataFrame, state: np.ndarray, shards: int, weights: tuple[float, float], turn: int) -> np.ndarray:
    """One round: every shard of the rows is learnt from in turn by a task of
    its own, starting from ``state``; a parameter moves by the mean of the
    shards that moved it.  Moves are added as integers and rows are learnt
    from in the order of a hash, so reruns agree."""
    unit = float(1 << 32)
    names = [f"m{i}" for i in range(2 * DIM)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descent, words, docs, toxic = _unpacked(state), Words(), [], []

        def step():
            y = np.array(toxic, np.float64)
            descent.step(words.bins, docs, y, np.where(y > 0, weights[1], weights[0]))
            docs.clear(), toxic.clear()
            if len(words.number) > CACHE_WORDS:
                words.clear()

        seen = False
        for b in batches:
            for text, t in zip(b.column("text"), b.column("toxic").to_pylist()):
                seen = True
                docs.append(words.of(text.as_py()))
                toxic.append(t)
                if len(docs) == BATCH:
                    step()
        if docs:
            step()
        if not seen:
            return
        moves = np.rint((_packed(descent).astype(np.float64) - state) * unit).astype(np.int64)
        at = np.flatnonzero(np.append(descent.touched, np.ones(len(state) - BINS, bool)))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(moves[at, i]) for i in range(2 * DIM)]], names=["row", *names])

    order = F.xxhash64("doc_id", F.lit(turn))
    x = rows.repartitionById(shards, F.col("shard")).select("text", "toxic", "doc_id", order.alias("h")).sortWithinPartitions(
        "h", "doc_id", "text").select("text", "toxic")
    got = x.mapInArrow(learn, "row long, " + ", ".join(f"{c} long" for c in names)).groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
    moves = np.stack([got[c].to_numpy() for c in names], axis=1) / (got["n"].to_numpy()[:, None] * unit)
    state = state.copy()
    state[got["row"].to_numpy()] += moves
    return state


def train_rows(rows: DataFrame, n: dict[int, int], shard_rows: int = SHARD_ROWS, seed: int = 7) -> Network:
    """``train`` on all rows (doc_id, text, toxic) of a written table, of which
    ``n`` has the number by class.

    Rows are dealt to shards of about ``shard_rows`` by their id; shards learn
    in parallel and meet after every round (``_descend``).  A small table is
    passed over up to EPOCHS times, a round each; one of VISITS rows or more
    once, in ROUNDS rounds.  The driver gets the parameters, whose number
    does not depend on the rows.
    """
    total = sum(n.values())
    if not (n.get(0) and n.get(1)):  # one class only: its share is all there is to learn
        return new_network(None, seed)
    share = n[1] / total
    state = _packed(Descent(new_network(presence_of(bin_counts(rows), share), seed))).astype(np.float64)
    weights = 0.5 / (1 - share), 0.5 / share
    shards = -(-total // shard_rows)
    passes = max(1, min(EPOCHS, -(-VISITS // total)))
    slices = -(-ROUNDS // passes)
    h = F.xxhash64(F.lit("shard"), "doc_id")
    rows = rows.withColumn("shard", F.pmod(h, F.lit(shards)).cast("int")).withColumn(
        "slice", F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.lit(slices)))
    for turn in range(passes * slices):
        state = _descend(rows.filter(F.col("slice") == turn % slices), state, shards, weights, turn)
    return _unpacked(state).net


def margins_of(rows: DataFrame, net: Network) -> DataFrame:
    """lang, toxic, margin of rows (lang, toxic, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            m = pa.array([scorer.margin(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), m], names=["lang", "toxic", "margin"])

    return rows.select("lang", "toxic", "text").mapInArrow(run, "lang string, toxic int, margin double")


def calibrate_rows(net: Network, margins: DataFrame, share: float) -> None:
    """``calibrate`` by aggregates over a written table (toxic, margin);
    scale and shift are rounded beyond what the order of a sum changes."""
    def sums(a: float, b: float, weights: tuple[float, float]) -> list[float]:
        m, t = F.col("margin"), F.col("toxic")
        w = F.when(t > 0, weights[1]).otherwise(weights[0])
        p = _calibrated(a, b)
        r, v = w * (p - t), w * p * (1 - p) + 1e-9
        return list(margins.agg(F.sum(r * m), F.sum(r), F.sum(v * m * m), F.sum(v * m), F.sum(v)).first())

    n = margins.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    logistic_fit(net, n["n"], n["toxic"], share, sums)
    net.scale, net.shift = round(net.scale, 9), round(net.shift, 9)


def _calibrated(scale: float, shift: float) -> Column:
    x = F.least(F.greatest(F.col("margin") * F.lit(scale) + F.lit(shift), F.lit(-30.0)), F.lit(30.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def language_thresholds(scores: DataFrame) -> dict[str, float]:
    """``best_threshold`` of every language with enough rows (lang, toxic,
    score) of both classes.  Scores are ranked by a distributed sort; the
    driver gets one row per language."""
    from botsift.operators.forest import rows_before

    scores = scores.filter("lang IS NOT NULL")
    all_ = scores.groupBy("lang").agg(F.sum("toxic").alias("all"), F.count(F.lit(1)).alias("rows")).filter(
        f"least(all, rows - all) >= {MIN_LANGUAGE}").select("lang", "all")
    n = scores.join(all_.select("lang"), "lang").groupBy("lang", (-F.col("score")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    x = rows_before(n, "lang", "value").withColumnRenamed("before", "rows")
    x = materialize(rows_before(x, "lang", "value", "hits").join(all_, "lang"), "ranked-scores")
    f1 = 2 * (F.col("before") + F.col("hits")) / (F.col("rows") + F.col("n") + F.col("all"))
    best = x.groupBy("lang").agg(F.max_by("value", F.struct(f1.alias("f1"), (-F.col("value")).alias("s"))).alias("best"))
    cuts = x.join(best, "lang").groupBy("lang", "best").agg(F.min(F.when(F.col("value") > F.col("best"), F.col("value"))).alias("next"))
    return {r["lang"]: -r["best"] if r["next"] is None else -(r["best"] + r["next"]) / 2 for r in cuts.collect()}


def fit(docs: DataFrame, labels: DataFrame, **params) -> Model:
    """Train on all labelled rows (``labelled_rows``), in shards; those that
    calibrate set the calibration and the languages' thresholds."""
    rows = materialize(labelled_rows(docs, labels), "labelled")
    n: dict[bool, dict[int, int]] = {False: {}, True: {}}
    for r in rows.groupBy("calibrates", "toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["calibrates"]][r["toxic"]] = r["n"]
    net = train_rows(rows.filter("NOT calibrates"), n[False], **params)
    margins = materialize(margins_of(rows.filter("calibrates"), net), "margins")
    toxic = sum(x.get(1, 0) for x in n.values())
    share = toxic / max(sum(sum(x.values()) for x in n.values()), 1)
    calibrate_rows(net, margins, min(max(share, 1e-3), 1 - 1e-3))
    return Model(net, language_thresholds(margins.select("lang", "toxic", _calibrated(net.scale, net.shift).alias("score"))))


def toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``_row`` (the columns ``keep``, all by default),
    score (0 to 1), predicted (1 if score >= 0.5), threshold (that of the
    row's language, else 0.5) and flagged (score >= threshold).

    The score depends on the text alone.  Defined results: a NULL text is
    scored as an empty one (no filter answers); bytes that are not UTF-8 are
    read as U+FFFD; equal texts have equal scores; an empty table gives no
    rows; a model fitted without both classes scores every text alike.
    """
    from pyspark.sql import types as T

    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.make_valid_utf8(F.col("text").cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), text.alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = T.StructType([rows.schema["_row"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    net, cuts = model.net, sorted(model.thresholds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for b in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("lang"), scores], names=["_row", "lang", "score"])

    cut = F.lit(0.5)
    for lang, at in cuts:
        cut = F.when(F.col("lang") == lang, F.lit(at)).otherwise(cut)
    s = rows.mapInArrow(run, schema).withColumn("threshold", cut)
    return s.select("_row", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "threshold",
                    (F.col("score") >= F.col("threshold")).alias("flagged"))
