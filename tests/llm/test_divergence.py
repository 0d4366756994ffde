import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from botsift.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLS = "doc_id bigint, text string, lang string, source string, n string, place string, total string, no string"


def price(p, q):
    return (p - q) ** 2 // (p + q)


def brute(rows, min_docs, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        groups.add((lang, source))
        terms = TERM.findall(low)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted((s for x, s in groups if x == lang), key=lambda s: s.encode())
        c = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        total = {s: sum(c[s].values()) + 2 * len(kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (c[s][t] + 2) // total[s] for t in kept} for s in sources}
        all_n = sum(total[s] - 2 * len(kept) for s in sources) + 2 * len(kept)
        q = {t: 1 + 10**9 * (sum(c[s][t] for s in sources) + 2) // all_n for t in kept}
        for s in sources:
            pairs = [(sum(price(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(price(p[s][t], q[t]), t) for t in kept if c[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])}
    return out


def corpus(seed, n=260, sources=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgÄé東") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        ws = [words[min(int(rng.expovariate(0.03)), 299)] for _ in range(rng.randint(0, 60))]
        text = " ".join(w.upper() if rng.random() < 0.2 else w for w in ws).replace(" a", "@a", 2).replace(" b", "\n3b[", 2)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(sources)] + [None])))
    rows += [(900, None, "en", "s0"), (900, None, "en", "s0"), (901, "", "en", "only null"), (902, None, "xx", "lonely"),
             (903, "rare words only", "yy", "a"), (903, "rare words only", "yy", "b"), (904, "123 !!", "yy", None),
             (None, "a b c " * 20000, "en", "s1"), (905, "x" * 300000, "en", "s1"), (906, "long\x00tail " * 30, "", "s2")]
    return [(*r, "a", "b", "c", "d") for r in rows]


def got(spark, rows, **kw):
    return {tuple(r) for r in dv.divergence_audit(spark.createDataFrame(rows, COLS), **kw).select(
        "lang", "source", "part", "item", "value", "rank").collect()}


def test_equals_brute_force(spark):
    rows = corpus(1)
    want = brute(rows, 10)
    assert got(spark, rows) == want and len(want) > 100


def test_many_blocks_and_chunks(spark):
    rows = corpus(2, n=400, sources=40)
    want = brute(rows, 3, top=4)
    assert got(spark, rows, min_docs=3, top_terms=4, block=16, chunk=4) == want
    assert got(spark, rows, min_docs=3, top_terms=4) == want
    assert len({s for lang, s, *_ in want if lang == "en"}) > dv.CHUNK


def test_small_tables(spark):
    assert got(spark, []) == set()
    one = [(1, "a b", "en", "s", "", "", "", "")]
    assert got(spark, one) == set()
    assert got(spark, one * 10) == set()  # the language's shares are the group's own
    two = one * 9 + [(2, "b b c", "en", "t", "", "", "", "")]
    assert got(spark, two) == brute(two, 10)


@pytest.mark.parametrize("groups,width", [(1, 1), (2, 1), (3, 2), (5, 37), (9, 256)])
def test_walk_prices_equal_direct_sums(groups, width):
    rng = np.random.default_rng(groups * width)
    counts = rng.geometric(0.4, (groups, width)) - 1
    totals = [int(c.sum()) + 2 * width + int(x) for c, x in zip(counts, rng.integers(0, 9, groups))]
    pairs = [(a, np.arange(a + 1, groups)) for a in range(groups - 1)]
    values = dv.pair_prices(counts, width, totals, pairs)
    share = lambda c, t: 1 + 10**9 * (int(c) + 2) // t
    for (a, others), v in zip(pairs, values):
        for o, value in zip(others, v):
            assert value == sum(price(share(x, totals[a]), share(y, totals[o])) for x, y in zip(counts[a], counts[o]))


def test_large_counts_are_exact():
    counts = np.array([[3 * 10**12, 7, 0, 1], [10**12 + 1, 0, 5, 1]])
    totals = [int(c.sum()) + 8 for c in counts]
    value = dv.pair_prices(counts, 4, totals, [(0, np.array([1]))])[0][0]
    p = [[1 + 10**9 * (int(c) + 2) // t for c in row] for row, t in zip(counts, totals)]
    assert value == sum(price(x, y) for x, y in zip(*p))


def test_equal_subtrees_are_one_node_and_one_price():
    row = np.array([9, 9, 5, 5] + [1] * 60)
    leaves, levels = dv.segment_trees(np.stack([row, row, np.append(row[:4], [0] * 60)]))
    assert list(leaves) == [0, 1, 5, 9] and levels[-1][0] == levels[-1][1] != levels[-1][2]
    assert [len(x) for x in levels[:-1]] == [4, 3, 4, 4, 4, 2]  # at most 4 distinct subtrees of any size, not 32
    at, x, y, times = dv.walk(levels, 0, np.array([1, 2]))
    assert len(at) == 6 and times.sum() == 128 and sorted(times) == [2, 2, 2, 2, 60, 60]


def test_term_pieces(monkeypatch):
    text = "Ab cD\n12e東 Ä".encode() * 50
    want = TERM.findall(text.decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    monkeypatch.setattr(dv, "PIECE_BYTES", 5)
    pieces = list(dv.terms_of(text))
    assert len(pieces) > 20 and [t.decode() for p in pieces for t in p] == want
    assert pa.array(pieces[0], pa.binary()).cast(pa.string()).to_pylist()
