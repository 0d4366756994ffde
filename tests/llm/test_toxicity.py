import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from botsift.llm import toxicity as tx

SF = "/root/testdata/sf0.1"
COLS = "doc_id bigint, text string, lang string, score string, _row string, predicted string"


def brute_maxima(net, x):
    """Every filter's largest answer, position by position."""
    out = []
    for k, b in zip(net.kernels, net.biases):
        w = len(k)
        y = list(x) + [np.zeros(tx.DIM)] * max(0, w - len(x))
        answers = [[sum(float(y[i + j] @ k[j][:, f]) for j in range(w)) + b[f] for f in range(tx.FILTERS)] for i in range(len(y) - w + 1)]
        out += [max(0.0, max(a[f] for a in answers)) for f in range(tx.FILTERS)]
    return np.array(out)


def some_net(seed=3):
    rng = np.random.default_rng(seed)
    return tx.Network(rng.normal(0, 0.3, (tx.BINS, tx.DIM)).astype(np.float32),
                      [rng.normal(0, 0.5, (w, tx.DIM, tx.FILTERS)).astype(np.float32) for w in tx.WIDTHS],
                      [rng.normal(0, 0.1, tx.FILTERS).astype(np.float32) for _ in tx.WIDTHS],
                      rng.normal(0, 0.3, tx.FILTERS * len(tx.WIDTHS)).astype(np.float32), 0.1)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_maxima_equal_brute_force(n):
    net, sc = some_net(), None
    words = [f"w{i % 7}," for i in range(n)]
    sc = tx.Scorer(net)
    x = sc.embed(words)
    want = np.stack([net.embedding[np.array([h % tx.BINS for h in tx.word_features(w)])].sum(axis=0) for w in words])
    assert np.allclose(x, want, atol=1e-5)
    got, at = net.maxima(x)
    assert np.allclose(got, brute_maxima(net, x), atol=1e-4)


def test_pieces_and_a_full_cache_do_not_change_scores(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["ab ", "cde\n", "f ", "\t", "gh! ", "東京 ", "I"]) for _ in range(4000))
    want = tx.Scorer(some_net()).score(text)
    assert [w for p in tx.word_pieces(text) for w in p] == [w for w in tx._SPACE.split(text) if w]
    monkeypatch.setattr(tx, "PIECE_CHARS", 50)
    monkeypatch.setattr(tx, "CACHE_WORDS", 20)
    assert [w for p in tx.word_pieces(text) for w in p] == [w for w in tx._SPACE.split(text) if w]
    assert abs(tx.Scorer(some_net()).score(text) - want) < 1e-5


def test_gradients_lower_the_loss_and_two_word_phrases_are_learnt():
    rng = random.Random(4)
    words = [f"{a}{b}o" for a in "bcdfgh" for b in "aeiou"]
    texts, toxic = [], []
    for i in range(300):  # both words are everywhere, only their order next to each other tells
        w = [rng.choice(words) for _ in range(30)]
        at = rng.randint(0, 28)
        w[at:at + 2] = ["zag", "nub"] if i % 2 else ["nub", "zag"]
        texts.append(" ".join(w))
        toxic.append(i % 2)
    net = tx.train(texts[:200], toxic[:200], epochs=25)
    sc = tx.Scorer(net)
    right = sum((sc.margin(t) > 0) == bool(y) for t, y in zip(texts[200:], toxic[200:]))
    assert right >= 90


def test_thresholds_and_calibration():
    s, t = np.array([0.9, 0.8, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0, 0])
    cut = tx.best_threshold(s, t)
    best = max((2 * ((s >= c) & (t == 1)).sum() / ((s >= c).sum() + t.sum()), c) for c in s)[0]
    assert 2 * ((s >= cut) & (t == 1)).sum() / ((s >= cut).sum() + t.sum()) == best
    net = some_net()
    rng = np.random.default_rng(1)
    m = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * m - 2)))).astype(int)
    tx.calibrate(net, m, y, float(y.mean()))
    assert abs(net.scale - 1.5) < 0.2 and abs(net.shift + 2) < 0.25


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return tx.fit(*tables)


def test_sample_is_bounded_and_never_held_out(tables):
    rows = tx.labelled_sample(*tables, positive=50, negative=80).collect()
    assert sum(r["toxic"] for r in rows) == 50 and len(rows) == 130
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    again = tx.labelled_sample(tables[0].repartition(5), tables[1].repartition(3), positive=50, negative=80).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in again)


def test_held_out_accuracy(spark, tables, model):
    docs, labels = tables
    out = tx.toxicity(docs.join(labels, "doc_id").filter(tx.held_out(F.col("doc_id"))), model, keep=["doc_id", "toxic"])
    rows = out.select("_row.toxic", "score", "predicted", "flagged").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    order = s.argsort().argsort()
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.95
    caught = sum(r["predicted"] for r in rows if r["toxic"])
    assert caught >= 0.75 * y.sum() and sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.02 * (y == 0).sum()


def test_score_is_of_the_text_alone_and_odd_rows(spark, model):
    rows = [(1, "a stupid clown, you idiot", "en", "a", "b", "c"), (2, "a stupid clown, you idiot", "zz", "a", "b", "c"),
            (2, "a stupid clown, you idiot", None, "a", "b", "c"), (None, None, None, "a", "b", "c"), (3, "", "en", "a", "b", "c"),
            (4, " \n\t", "en", "a", "b", "c"), (5, "one", "de", "a", "b", "c"), (6, "idiot " + "and the " * 120000, "en", "a", "b", "c"),
            (7, "x" * 300000, "en", "a", "b", "c"), (8, "\x00 \U0001f600 東京 *** !!!", "fr", "a", "b", "c")]
    got = tx.toxicity(spark.createDataFrame(rows, COLS), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["_row"]["doc_id"]: r["score"] for r in got}
    assert len({r["score"] for r in got if r["_row"]["text"] and "clown" in r["_row"]["text"]}) == 1
    assert by[None] == by[3] == by[4] and by[1] > 0.9
    assert got[0]["_row"]["score"] == "a"
    assert tx.toxicity(spark.createDataFrame([], COLS), model).count() == 0


def test_odd_labels(spark):
    d = spark.createDataFrame([(i, f"text {i}" if i % 9 else None, "en", "a", "b", "c") for i in range(60)], COLS)
    none = tx.fit(d, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    one = tx.fit(d, spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 1, 1), (3, 1, None), (4, 1, 7)],
                                          "doc_id bigint, quality int, toxic int"))
    for m in (none, one):
        s = {r["score"] for r in tx.toxicity(d, m).collect()}
        assert len(s) == 1 and s.pop() < 0.5 and m.thresholds == {}


def test_every_labelled_row_is_learnt_from(spark):
    """Texts of any length teach: all toxic rows here are longer than a
    sample took, and one word at their end tells."""
    rng = random.Random(5)
    words = [f"{a}{b}o" for a in "bcdfgh" for b in "aeiou"]
    long = " ".join(rng.choice(words) for _ in range(tx.SAMPLE_CHARS // 4 + 10))
    rows = [(i, (long if i % 4 == 0 else " ".join(rng.choice(words) for _ in range(30))) + (" zagnub" if i % 4 == 0 else ""),
             "en", "a", "b", "c") for i in range(80)]
    docs = spark.createDataFrame(rows, COLS).repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id bigint, quality int, toxic int")
    sc = tx.Scorer(tx.fit(docs, labels).net)
    assert len(long) > tx.SAMPLE_CHARS and sc.score("bao zagnub beo") > sc.score("bao beo") + 0.2
    x = tx.labelled_rows(docs, labels).collect()
    assert {r["doc_id"] for r in x} == {i for i in range(80) if zlib.crc32(str(i).encode()) % 5}
    assert all(r["calibrates"] == (zlib.crc32(f"c{r['doc_id']}".encode()) % 4 == 0) for r in x)


def test_counts_and_shards_take_every_row_and_reruns_agree(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = [(i // 2, " ".join(rng.choice(words) for _ in range(12)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    rows += [(500, "", 0), (501, " \n", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    ws = tx.Words()
    texts = [ws.of(r[1]) for r in rows]
    want = np.zeros((2, tx.BINS))
    for r, t in zip(rows, texts):
        want[r[2], np.unique(ws.bins[t])] += 1
    assert (tx.bin_counts(d.repartition(5)) == want).all()

    monkeypatch.setattr(tx, "VISITS", 400)
    n = {1: sum(r[2] for r in rows), 0: sum(1 - r[2] for r in rows)}
    a = tx.train_rows(d.repartition(3), n, shard_rows=50)
    b = tx.train_rows(d.repartition(7), n, shard_rows=50)
    assert all((x == y).all() for x, y in zip(tx.Descent(a).params, tx.Descent(b).params)) and a.out_bias == b.out_bias
    sc = tx.Scorer(a)
    assert sc.margin("w1 vile w2") > sc.margin("w1 w2")


def test_calibration_and_thresholds_of_tables_equal_those_in_memory(spark):
    rng = np.random.default_rng(8)
    rows = []
    for lang in ("en", "de", "fr", None):
        for _ in range(15 if lang == "fr" else 200):
            m = round(float(rng.normal(0, 2)), 1)
            rows.append((lang, int(rng.random() < 1 / (1 + np.exp(-m + 1))), m))
    d = spark.createDataFrame(rows, "lang string, toxic int, margin double")
    m, t = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    a, b = some_net(), some_net()
    tx.calibrate(a, m, t, 0.1)
    tx.calibrate_rows(b, d, 0.1)
    assert abs(a.scale - b.scale) < 1e-6 and abs(a.shift - b.shift) < 1e-6
    got = tx.language_thresholds(d.select("lang", "toxic", tx._calibrated(b.scale, b.shift).alias("score")))
    assert set(got) == {"en", "de"}
    for lang, cut in got.items():
        at = np.array([r[0] == lang for r in rows])
        assert abs(cut - tx.best_threshold(tx._sigmoid(b.scale * m[at] + b.shift), t[at])) < 1e-9


def test_calibration_does_not_overshoot():
    """Few margins far from 0: the fit ends where its gradient is 0."""
    m = np.concatenate([np.linspace(-9, -1, 70), np.linspace(-6, 6, 8)])
    t = np.repeat([0, 1], [70, 8])
    net = some_net()
    tx.calibrate(net, m, t, 0.12)
    w = np.where(t > 0, 0.12 / t.mean(), 0.88 / (1 - t.mean()))
    r = w * (tx._sigmoid(net.scale * m + net.shift) - t)
    assert abs(r.sum()) < 1e-6 and abs((r * m).sum() + net.scale - 1.0) < 1e-6
