import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from botsift.llm.mixing import mix, mixed_documents, source_sizes
from botsift.llm.sharding import assign_shards, pack


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows, share=1.5, cap=2, weights=(3, 1, 2)):
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        words = share * sum(total.values()) - sum(cap * total[s] for s in full)
        level = words / (sum(w[s] for s in total if s not in full) or 1)
        over = {s for s in total if s not in full and level * w[s] > cap * total[s]}
        if not over:
            return {s: (total[s], float(cap * total[s]) if s in full else level * w[s]) for s in total}
        full |= over


def draw(r):
    key = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
    return int(hashlib.md5(f"mix-1|{key}".encode()).hexdigest()[:13], 16) / 2**52


def test_mix_matches_brute_force(docs, rows):
    t = brute_targets(rows)
    want = []
    for r in rows:
        total, target = t[r[3]]
        rate = target / total if total else 0.0
        want.append((r[0], size(r[1]), total, round(target, 6), int(rate // 1 + (draw(r) < rate % 1))))
    got = [(x["_row"]["doc_id"], x["size"], x["source_size"], round(x["target"], 6), x["copies"]) for x in mix(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(w[-1] for w in want)
    assert abs(sum(v[1] for v in t.values()) - 1.5 * sum(v[0] for v in t.values())) < 1e-6
    assert all(v[1] <= 2 * v[0] for v in t.values())


def test_many_sources_keep_code_point_order(spark):
    names = [f"s{i:04d}" for i in range(700)] + ["Z", "é", "\U0001f600", None]
    d = spark.createDataFrame([(n, 5) for n in names], "source string, size bigint").repartition(7)
    got = {r["source"]: r["place"] for r in source_sizes(d, "size").collect()}
    order = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    assert got == {s: i for i, s in enumerate(order)}


def test_mix_edges(spark, no_docs):
    assert mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert {(r["size"], r["copies"]) for r in mix(blank).collect()} == {(0, 0)}


def test_shards(docs, rows):
    got = assign_shards(docs, shards=4, bundles=8).collect()
    assert Counter(str(r["_row"]["doc_id"]) for r in got) == Counter(str(r[0]) for r in rows)
    assert all(r["size"] == len((r["_row"]["text"] or "").encode()) + 1 for r in got)
    assert all(r["text_crc32"] == zlib.crc32((r["_row"]["text"] or "").encode()) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard_of = defaultdict(set)
    for r in got:
        shard_of[r["_row"]["text"]].add(r["shard"])
    half = sum(r["size"] for r in got) / 8
    for text, where in shard_of.items():
        if sum(r["size"] for r in got if r["_row"]["text"] == text) <= half:
            assert len(where) == 1


def test_shards_are_near_equal_and_split_hot_groups(spark, no_docs):
    hot = [(i, "the very same text " * 20) for i in range(600)]
    rows = hot + [(1000 + i, f"text {i} " + "word " * (i * 7 % 90)) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    total = defaultdict(int)
    for r in assign_shards(d, shards=8, bundles=64, keep=["doc_id"]).collect():
        total[r["shard"]] += r["size"]
    assert len(total) == 8
    assert max(total.values()) - min(total.values()) < 0.02 * sum(total.values()) / 8
    assert assign_shards(no_docs).count() == 0


def test_pack_places_by_dot_product():
    v = np.array([[10.0, 1, 1], [10, 1, 1], [1, 10, 1], [1, 10, 1]])
    s = pack(v, 2)
    assert s[0] != s[1] and s[2] != s[3]


def spread(vectors, where, shards):
    loads = np.stack([vectors[where == s].sum(axis=0) for s in range(shards)])
    return (loads.max(axis=0) - loads.min(axis=0)) / loads.mean(axis=0)


def test_pack_is_near_the_best_assignment():
    """Every assignment of a few items, by brute force: the packing's largest
    deviation is not far from the least possible."""
    rng = np.random.default_rng(5)
    for _ in range(12):
        v = rng.integers(1, 60, (9, 3)).astype(float)
        best = min(spread(v, np.array(a), 2)[0] for a in itertools.product(range(2), repeat=9) if len(set(a)) == 2)
        assert spread(v, pack(v, 2), 2)[0] <= best + 0.12
    assert len(pack(np.zeros((0, 3)), 4)) == 0 and list(pack(np.ones((3, 3)), 1)) == [0, 0, 0]


def test_pack_balances_all_dimensions():
    rng = np.random.default_rng(6)
    size = rng.lognormal(6, 1.2, 1500)
    v = np.stack([size, size / rng.uniform(4, 9, 1500), np.ones(1500)], axis=1).round()
    s = spread(v, pack(v, 16), 16)
    assert s[0] < 0.003 and s[1] < 0.06 and s[2] < 0.05


def test_hot_text_without_ids_is_spread(spark):
    hot = [(None, "the very same text " * 20) for _ in range(600)] + [(7, "another repeated text " * 20) for _ in range(300)]
    rows = hot + [(1000 + i, f"text {i} " + "word " * (i * 7 % 90)) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = assign_shards(d, shards=8, bundles=64).collect()
    total, slots = defaultdict(int), defaultdict(list)
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert Counter(map(str, (r["_row"]["doc_id"] for r in got))) == Counter(str(r[0]) for r in rows)
    assert max(total.values()) - min(total.values()) < 0.03 * sum(total.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
