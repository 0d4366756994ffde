import itertools
from collections import Counter

import numpy as np

from botsift.llm.components import connected_components
from botsift.llm.neardup import drop_near_duplicates, half_keys, near_duplicates


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, k, percent=80):
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    full = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(full, 2) if 100 * len(x & y) >= percent * len(x | y)]
    comp = components({i for i, _ in sets if i is not None}, links)
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets), key=str)


def test_matches_brute_force(docs, rows):
    for k in (2, 5):
        assert sorted((tuple(r) for r in near_duplicates(docs, shingle_words=k).collect()), key=str) == brute(rows, k)


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for step in range(12):  # neighbours are similar, the ends are not
        rows.append((100 - step, " ".join(base), 0))
        for j in range(15):
            base[(step * 15 + j) % 400] = f"n{step}_{j}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    want = brute(rows, 2)
    assert len({w[2] for w in want}) == 1
    assert sorted((tuple(r) for r in near_duplicates(docs, shingle_words=2).collect()), key=str) == want


def kept_rows(rows, k):
    """One document of each group: rows without an id are named by their
    text, after all ids; of equal rows of one name one stays."""
    texts = sorted({r[1] or "" for r in rows})
    names = [r[0] if r[0] is not None else 2**62 + texts.index(r[1] or "") for r in rows]
    lost = {b[0] for b in brute([(n, *r[1:]) for n, r in zip(names, rows)], k) if not b[3]}
    out, seen = [], set()
    for n, r in zip(names, rows):
        if n in lost or (n, r[1] or "") in seen:
            continue
        out.append(r)
        if r[0] is not None or r[1]:
            seen.add((n, r[1] or ""))
    return out


def test_drop(spark, docs, rows, no_docs):
    out = drop_near_duplicates(docs, shingle_words=2)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(r[:2] for r in kept_rows(rows, 2))
    assert near_duplicates(no_docs).count() == 0


def test_half_keys_do_not_depend_on_blocks_or_order():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (half_keys(s, 4, 3) == half_keys(s[::-1].copy(), 4, 3)).all()


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(200, x) for x in range(201, 260)] + [(300, 300), (None, 7), (401, 400)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = components({x for p in links for x in p if x is not None}, [p for p in links if None not in p])
    want.pop(300)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_drop_keeps_one_of_copies_without_ids(spark):
    prose = lambda k: " ".join(f"word{k * 31 + i * 7 % 97}" for i in range(60))
    near = prose(1).replace("word31", "changed", 1)
    rows = [(None, prose(0)), (None, prose(0)), (None, prose(0)), (5, prose(1)), (None, near), (None, prose(1)), (6, prose(2)), (6, prose(2)),
            (6, prose(3)), (8, prose(4)), (9, prose(4)), (None, None), (None, ""), (None, None), (10, None), (11, None), (-3, prose(5)), (None, prose(5))]
    rows = [(*r, "a", "b", "c", f"x{i}") for i, r in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, row string, copy string, _row string, n string").repartition(3)
    out = drop_near_duplicates(d)
    assert out.columns == d.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter({(None, prose(0)): 1, (5, prose(1)): 1, (6, prose(2)): 1, (6, prose(3)): 1, (8, prose(4)): 1,
                           (None, None): 2, (None, ""): 1, (10, None): 1, (11, None): 1, (-3, prose(5)): 1})
    assert drop_near_duplicates(d.limit(0)).count() == 0
