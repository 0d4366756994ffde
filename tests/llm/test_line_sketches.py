"""Pairs of a bucket that their sketches rule out are no rows."""
import itertools
import random

from pyspark.sql import functions as F

from botsift.llm import links

from .test_line_disk import chain
from .test_neardup import components


def table(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node bigint, s array<bigint>")


def linked(x, y):
    return 100 * len(x & y) >= 80 * len(x | y)


def found(spark, sets, buckets, monkeypatch):
    """Components by ``bucket_links`` with sketches, and the pairs verified."""
    t, seen = table(spark, sets), []

    def verify(pairs):
        got = [(r["a"], r["b"]) for r in pairs.collect()]
        seen.append(got)
        return spark.createDataFrame([p for p in got if linked(sets[p[0]], sets[p[1]])], "a bigint, b bigint")

    monkeypatch.setattr(links, "_blocks", lambda *_: 1 / 0)  # sets in blocks were copied for every block they met
    own = lambda n: t.join(n, "node", "left_semi")
    sketches = lambda n: links.sketched(own(n).select("node", F.explode("s").alias("e")))
    out = links.bucket_links(buckets, t.select("node", F.size("s").alias("n")), own, verify, 80, 2, sketches)
    return components(sets, [(r["a"], r["b"]) for r in out.collect()]), seen


def test_links_between_components_are_all_found(spark, monkeypatch):
    sets, buckets, want = chain(spark)
    for part in (links.PART, 2):  # whole buckets, and buckets dealt in parts
        monkeypatch.setattr(links, "PART", part)
        got, seen = found(spark, sets, buckets, monkeypatch)
        assert got == want
        assert all(len(x) == len(set(x)) for x in seen)


def test_far_pairs_of_a_large_bucket_are_no_rows(spark, monkeypatch):
    """A bucket of sets that share half their elements, some of them linked."""
    rng = random.Random(8)
    common = set(rng.sample(range(1 << 40), 60))
    sets = {i: common | set(rng.sample(range(1 << 40), 60)) for i in range(150)}
    for i in range(0, 20, 2):
        sets[200 + i] = set(sorted(sets[i])[5:])  # 115 of 120: linked
    keyed = spark.createDataFrame([(1, i, len(s)) for i, s in sets.items()], "key bigint, node bigint, n int")
    want = components(sets, [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if linked(sets[a], sets[b])])
    got, seen = found(spark, sets, links.shared_buckets(keyed), monkeypatch)
    assert got == want
    assert len(seen[-1]) <= 15  # of 12,720 pairs


def test_a_sketch_bounds_what_differs(spark):
    rng = random.Random(9)
    sets = {i: {rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 400))} for i in range(12)}
    sets |= {100 + i: set(sorted(s)[: 1 + len(s) // 2]) for i, s in sets.items()}
    rows = table(spark, sets).select("node", F.explode("s").alias("e"))
    w = {r["node"]: [r[f"w{i}"] for i in range(links.WORDS)] for r in links.sketched(rows).collect()}
    assert w.keys() == sets.keys()
    for a, b in itertools.combinations(sets, 2):
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(w[a], w[b]))
        assert bits <= len(sets[a] ^ sets[b])
    full = {(e >> 6) % links.WORDS * 64 + e % 64 for e in sets[0]}
    assert sum((x & (1 << 64) - 1).bit_count() for x in w[0]) == len(full)
