import hashlib
import re

from botsift.llm.decontam import build_index, contamination, drop_contaminated, near_passages

ITEMS = "item_id bigint, text string, n_words string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, items, window=10):
    out = []
    for r in rows:
        w = words(r[1])
        hit, ids = set(), set()
        for item_id, text, _ in items:
            v = words(text)
            width = min(window, len(v))
            for s in range(len(v) - width + 1 if v else 0):
                for p in range(len(w) - width + 1):
                    if w[p:p + width] == v[s:s + width]:
                        hit.update(range(p, p + width))
                        if item_id is not None:
                            ids.add(str(item_id))
        listed = ",".join(sorted(ids))
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def items_of(rows):
    t = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 100}
    return [
        (1, " ".join(words(t[0])[5:25]), "x"), (2, "Zu kurz.", "x"), (10, t[7].split("\n")[-2], "x"), (3, None, "x"),
        (4, "", "x"), (5, "ONE", "x"), (6, " ".join(words(t[2])[:9] + ["unseenword"]), "x"), (None, t[12][:120], "x"),
        (7, t[12][:120], "x"), (7, t[12][:120], "x"), (8, " ".join(reversed(words(t[1])[3:10])), "x"), (9, "ärger über öl", "x")]


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_matches_brute_force(spark, docs, rows):
    items = items_of(rows)
    got = contamination(docs, spark.createDataFrame(items, ITEMS))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r) for r in got.select(COLS).collect()), key=key) == sorted(brute(rows, items), key=key)


def test_periodic_texts(spark):
    rows = [(1, "ha " * 200, 0), (2, "ha ho " * 30, 0), (3, "ho " * 9, 0)]
    items = [(1, "ha " * 15, "x"), (2, "ho ha " * 6, "x"), (3, "ho", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_hit int")
    got = contamination(docs, spark.createDataFrame(items, ITEMS))
    assert sorted(tuple(r) for r in got.select(COLS).collect()) == sorted(brute(rows, items))


def test_rows_without_id_are_judged_by_their_own_text(spark):
    rows = [(None, "plain words only", 0), (None, "the leak the leak the end", 0), (None, "the " * 500, 0), (None, None, 0),
            (7, "the leak", 0), (7, "no such thing", 0), (7, "the leak", 0)]
    items = [(1, "the", "x"), (2, "leak the", "x"), (None, "plain words", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, t int").withColumnRenamed("t", "pid")
    got = contamination(docs.selectExpr("*", "1 AS d", "2 AS w"), spark.createDataFrame(items, ITEMS))
    assert sorted(map(str, map(tuple, got.select(COLS).collect()))) == sorted(map(str, brute(rows, items)))
    near = {r["n_words"]: r["near_items"] for r in got.filter("doc_id IS NULL").collect()}
    assert near == {3: 0, 6: 2, 500: 1, 0: 0}


def test_drop_keeps_columns_and_clean_rows(spark, docs, rows):
    items = items_of(rows)
    out = drop_contaminated(docs, spark.createDataFrame(items, ITEMS))
    assert out.columns == docs.columns
    assert out.count() == sum(not b[-1] for b in brute(rows, items))


def test_empty_tables(spark, docs, no_docs, rows):
    items = spark.createDataFrame(items_of(rows), ITEMS)
    assert contamination(no_docs, items).count() == 0
    none = contamination(docs, spark.createDataFrame([], ITEMS))
    assert none.filter("contaminated OR n_hit > 0 OR near_items > 0").count() == 0
    assert none.count() == len(rows)


def test_near(spark):
    from botsift.llm.decontam import _term_counts, passages

    docs = spark.createDataFrame([(1, "red x x blue x x green"), (2, "red " + "x " * 40 + "blue green"), (3, "green blue red"),
                                  (4, "red blue")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "blue green red", "x")], ITEMS)
    index = build_index(docs)
    near = near_passages(index, _term_counts(index, passages(items)), k=3, slop=20)
    assert sorted(r["d"] for r in near.collect()) == [1, 3]
