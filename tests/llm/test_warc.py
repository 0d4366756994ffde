import gzip
import hashlib
import io
import random

import pytest

from botsift.llm.warc import _member, _record, archive_pages, read_archives, records_in, with_record_types, write_archives
from botsift.session import scratch_path

PAGES = "page_id bigint, url string, html string, payload string"


def pages_rows():
    rng = random.Random(4)
    big = ["".join(rng.choice("abc <>é") for _ in range(1500)) for _ in range(4)]
    rows = [(i, f"http://h/{i}", big[i % 4] if i % 3 else f"<p>{i}</p>", "x") for i in range(60)]
    return rows + [(100, None, None, "x"), (101, "http://h/e", "", "x"), (102, "u v\nw", "same small", "x"), (103, "u", "same small", "x"),
                   (None, "u", big[0], "x"), (104, "u", big[1], "x"), (104, "u", big[1], "x"), (105, "u", "z" * 2_000_000, "x"),
                   (-7, "u", "é" * 500, "x"), (-9, "u", "é" * 500, "x"), (-11, "u", "a" * 999, "x"), (-12, "u", "a" * 999, "x")]


def brute(rows):
    top = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            top[data] = max(top.get(data, i), i)
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        first = top.get(data)
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [700, 64_000, 8 << 20])
def test_round_trip(spark, split):
    rows = pages_rows()
    got = archive_pages(spark.createDataFrame(rows, PAGES), split_bytes=split)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_archives_are_gzip_members(spark):
    rows = pages_rows()
    folder = scratch_path(spark, "warc-test")
    m = write_archives(with_record_types(spark.createDataFrame(rows, PAGES)).coalesce(2), folder).collect()
    assert sum(r["records"] for r in m) == len(rows)
    whole = b"".join(gzip.open(r["file"].removeprefix("file:")).read() for r in m)
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    r = read_archives(spark, folder, split_bytes=5000)
    assert r.count() == len(rows)
    assert r.select("file", "offset").distinct().count() == len(rows)


def test_every_split_point_owns_each_record_once():
    rng = random.Random(5)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))) for _ in range(20)]
    bodies[3] = b"\x1f\x8b\x08" * 50  # magic inside a payload
    bodies[4] = _member(_record(99, "u", b"inner", "d", "response", None))  # a member inside a payload
    data = b"".join(_member(_record(i, "u", b, "d", "response", None)) for i, b in enumerate(bodies))
    for step in (37, 501, len(data)):
        got = [(h["warc-record-id"], p) for s in range(0, len(data), step)
               for _, h, p in records_in(io.BytesIO(data), len(data), s, min(s + step, len(data)))]
        assert got == [(f"<urn:page:{i}>", b) for i, b in enumerate(bodies)]


def test_damage_is_skipped():
    data = bytearray(b"".join(_member(_record(i, "u", b"x" * 500, "d", "response", None)) for i in range(6)))
    first = len(_member(_record(0, "u", b"x" * 500, "d", "response", None)))
    data[first + 20] ^= 0xFF  # the second member no longer decodes
    got = [h["warc-record-id"] for _, h, _ in records_in(io.BytesIO(bytes(data)), len(data), 0, len(data))]
    assert got == [f"<urn:page:{i}>" for i in (0, 2, 3, 4, 5)]


def test_no_pages(spark):
    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0
