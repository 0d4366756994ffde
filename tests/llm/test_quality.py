import re
from collections import Counter
from math import log2

import sentencepiece

from botsift.llm.quality import BANDS, PIECES, VOCABULARIES, drop_low_quality, fences, quality, repeated_words


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text):
    text, w = text or "", words(text)
    win = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(1 for i, x in enumerate(lines) if x in lines[:i]) if len(lines) < 2000 else len(lines) - len(set(lines)), len(hit))


def test_base_counts_match_brute_force(docs, rows):
    got = quality(docs).collect()
    assert sorted((tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got)
                  ) == sorted(brute(r[1]) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_piece_measures_are_those_of_the_whole_text(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{VOCABULARIES}/{PIECES}")
    for r in quality(docs).collect():
        text = r["_row"]["text"]
        if not text or len(text) > 5000:
            continue
        ids = sp.encode(" ".join(words(text)))
        n = Counter(ids)
        assert r["n_pieces"] == len(ids)
        assert r["n_bytes"] == sum(v for k, v in n.items() if sp.is_byte(k))
        want = -sum(v / len(ids) * log2(v / len(ids)) for v in n.values()) if ids else 0.0
        assert abs(r["entropy"] - want) < 1e-9


def test_repeated_words_at_the_edges():
    for text in ("a b c d e f g h", "a " * 8, "a " * 9, "a b c d e f g h " * 2, "a b c d e f g h i " * 3 + "x y", ""):
        w = text.encode().split()
        assert repeated_words(w) == brute(text)[4], text


def test_bands(spark):
    prose = ("The committee met on Tuesday to discuss the annual budget, and several members raised concerns about "
             "the cost of the new library building near the old harbour.")
    junk = " ".join("" * 3 for _ in range(40))
    same = " ".join(f"the{'.' * (i % 2)} the" for i in range(200))
    rows = [(1, prose, "en"), (2, prose, "xx"), (3, prose, None), (4, junk, "en"), (5, same, "en"), (6, None, "en")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["_row"]["doc_id"]: r["kept"] for r in quality(d).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    strict = {k: (5.9, 6.0, *v[2:]) for k, v in BANDS.items()}
    assert quality(d, bands=strict).filter("kept").count() == 0
    assert quality(d.drop("lang")).filter("kept").count() == 3


def test_drop_and_empty(docs, no_docs):
    out = drop_low_quality(docs)
    assert out.columns == docs.columns
    assert out.count() == quality(docs).filter("kept").count() > 0
    assert quality(no_docs).count() == 0


def brute_fences(rows, margin, min_texts):
    """Quartiles by sorting, over texts that differ in group or counts."""
    texts = {((r["lang"] or "").lower() or None, r["script"], r["word_chars"], r["n_pieces"], r["n_byte_level"])
             for r in rows if not r["base_failed"]}
    out = {}
    for kind, at in (("lang", 0), ("script", 1)):
        for name in {t[at] for t in texts} - {None}:
            ends = []
            for of in (3, 4):
                v = sorted(100 * t[2] // t[of] for t in texts if t[at] == name)
                q1, q2, q3 = (v[-(-k * len(v) // 4) - 1] for k in (1, 2, 3))
                ends += [min(q1 - margin * (q3 - q1), 85 * q2 // 100), max(q3 + margin * (q3 - q1), -(-125 * q2 // 100))]
                enough = len(v) >= min_texts
            if enough:
                out[kind, name] = ends
    return out


def test_fences_match_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for margin, min_texts in ((6, 100), (1, 30)):
        rows = quality(d, margin=margin, min_texts=min_texts).collect()
        want = brute_fences(rows, margin, min_texts)
        got = fences(spark.createDataFrame(rows), margin, min_texts)
        assert {(r["kind"], r["name"]): list(r["of"]) for r in got.collect()} == want and ("lang", "en") in want
        rejected = 0
        for r in rows:
            b = BANDS[r["lang"] or r["script"]]
            fixed = not r["base_failed"] and (
                b[0] <= r["chars_per_piece"] <= b[1] and b[2] <= r["chars_per_byte_level"] <= b[3]
                and r["byte_share"] <= b[4] and r["rel_entropy"] >= b[5])
            f = want.get(("lang", r["lang"])) or want.get(("script", r["script"]))
            inside = fixed and (f is None or all(
                lo <= 100 * r["word_chars"] // r[c] <= hi for c, lo, hi in (("n_pieces", *f[:2]), ("n_byte_level", *f[2:]))))
            assert r["kept"] == inside, r
            rejected += fixed and not inside
        assert rejected


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    q = [(label.get(r["doc_id"]), r["kept"]) for r in quality(spark.read.parquet(f"{sf}/documents.parquet")).filter(
        "NOT base_failed").select("_row.doc_id", "kept").collect()]
    assert all(kept for good, kept in q if good == 1)
    junk = [kept for good, kept in q if good == 0]
    assert sum(junk) <= len(junk) * 0.35  # 15 of 28 under the fixed bands alone


def test_copies_do_not_set_the_fences(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    one = d.filter("lang = 'en' AND length(text) BETWEEN 500 AND 2000").orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(600)).drop("id")
    keep = lambda x: {(r["_row"]["doc_id"], r["kept"]) for r in quality(x).collect()}
    assert keep(d.unionByName(copies)) == keep(d)
