import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from botsift.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
S = ("<P>", "<S>", "<M>")


def brute(doc_id, text, seed="42", rate=50, spm_rate=80, marks=S):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return n, "spm", s + suf + p + pre + m + mid, len(pre), len(mid)
    return n, "psm", p + pre + s + suf + m + mid, len(pre), len(mid)


def texts():
    rng = random.Random(5)
    odd = ["", " ", "\n\t ", "a", " a", "a ", "a\x00b \x00", "\x1c\x85 x y", "ÄÖ 東京 \U0001f600 z \x0b\x0c\r", "<P", "P> <S", "<<M>",
           "has <P> in it", "<S>", "x<M>y", "<P", "a <", "<S", "  b�"]
    many = ["".join(rng.choice("ab <PSM>\n\té東") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return odd + many + ["word " * 40000, "x" * 200000]


def check(spark, rows, **kw):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n string, output string, _row string, form string")
    out = fim.fill_in_middle(d, **kw).withColumn("back", fim.restored(F.col("output"), F.col("form"), kw.get("sentinels", S)))
    got = sorted(((r["_row"]["doc_id"], r["_row"]["text"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["back"])
                  for r in out.collect()), key=str)
    args = {"seed": kw.get("seed", "42"), "rate": kw.get("rate", 50), "spm_rate": kw.get("spm_rate", 80), "marks": kw.get("sentinels", S)}
    want = sorted(((r[0], r[1], *brute(r[0], r[1], **args), r[1] or "") for r in rows), key=str)
    assert got == want
    return got


def test_equals_brute_force(spark):
    rows = [(i, t, "a", "b", "c", "d") for i, t in enumerate(texts())]
    rows += [(None, "two words", "a", "b", "c", "d"), (None, None, "a", "b", "c", "d"), (3, None, "a", "b", "c", "d"),
             (3, "again x", "a", "b", "c", "d"), (3, "again x", "a", "b", "c", "d"), (-7, "minus seven here", "a", "b", "c", "d")]
    forms = {r[3] for r in check(spark, rows)}
    assert forms == {"plain", "psm", "spm"}


def test_all_texts_and_other_sentinels(spark):
    rows = [(i, t, "a", "b", "c", "d") for i, t in enumerate(texts()[:150])]
    check(spark, rows, seed="7", rate=100, spm_rate=0)
    check(spark, rows, rate=100, spm_rate=100, sentinels=("<|p|>", "<|s|>", "<|m|>"))


def test_slices_do_not_change_results(spark, monkeypatch):
    t = pa.array(texts()[:200])
    h = [pa.array([(i * 7919 + k * 104729) % 2**32 for i in range(200)], pa.int64()) for k in range(4)]
    whole = fim.infill(t, h)
    batch = pa.RecordBatch.from_arrays([t, *h], names=["text", "h0", "h1", "h2", "h3"])
    parts = list(fim._slices(batch, "text", 64))
    assert len(parts) > 20
    for k, v in whole.items():
        got = [x for p in parts for x in fim.infill(p.column("text"), [p.column(f"h{i}") for i in range(4)])[k].to_pylist()]
        assert got == v.to_pylist()


def test_clashing_columns_and_empty_table(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, h0 string, _row string")
    assert fim.fill_in_middle(d).count() == 0
    d = spark.createDataFrame([(1, "a b c", "x", "y")], d.schema)
    r = fim.fill_in_middle(d).first()
    assert r["_row"].asDict() == {"doc_id": 1, "text": "a b c", "h0": "x", "_row": "y"}


def test_not_utf8(spark):
    d = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF20FE62' AS STRING) AS text")
    r = fim.fill_in_middle(d, rate=100).withColumn("back", fim.restored(F.col("output"), F.col("form"))).first()
    assert r["back"] == "a� �b"


@pytest.mark.parametrize("key", ["op13_fill_in_middle"])
def test_query_round_trip(spark, key):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    out = entry.queries()[key](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert out.filter(F.col("restored_sha256") != F.sha2(F.coalesce("text", F.lit("")), 256)).count() == 0
    assert out.count() == 200
