"""Passages of just over 50 short words, each planted in two documents."""
import random

from botsift.llm.cdc import extend, repeated_spans


def test_short_passages_are_found_to_their_ends(spark):
    rng = random.Random(13)
    words = lambda low, high, n: " ".join(
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high))) for _ in range(n))
    rows, planted = [], {}
    for i in range(300):
        passage = words(2, 5, 51)
        for doc in (i, 1000 + i):
            before = words(2, 9, rng.randint(0, 60)) + " ä "
            rows.append((doc, f"{before}{passage} {words(2, 9, rng.randint(5, 60))}"))
            planted[doc] = (len(before.encode()), len((before + passage).encode()))
    rows.append((5000, words(2, 9, 500)))
    got = {}
    for r in repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert 5000 not in got
    whole = 0
    for doc, (s, e) in planted.items():
        if doc in got:
            (r,) = got[doc]
            # chance may lengthen a passage by a few equal characters, nothing shortens it
            assert s - 12 <= r["span_start"] <= s and e <= r["span_end"] <= e + 12
            assert r["is_first"] == (doc < 1000) and r["first_doc_id"] == doc % 1000
            whole += 1
    assert whole >= 0.995 * len(planted)


def test_extend():
    assert extend(b"xxabcdefyy", b"zabcdefzz", 4, 6, 3) == (2, 8)
    long = bytes(random.Random(14).randrange(256) for _ in range(5000))
    assert extend(b"1" + long + b"2", b"34" + long + b"5", 2000, 2020, 2001) == (1, 5001)
    assert extend(long, long, 100, 120, 100) == (0, 5000)
