"""WARC archives: a writer with revisit records and a splittable reader.

An archive is a file of gzip members, one record each.  The reader deals out
byte ranges of the files.  A task looks for gzip magic in its range, takes a
candidate for a member only if it decodes to a WARC header block, and owns
the records that start inside its range: it reads the last one past the
range's end if need be, and skips what a record begun before its range left.
Once a true member is found the next starts where it ended, so the scan for
magic is only needed at the front of a range (or after damage).

Files are reached through pyarrow's filesystems by URI, so archives can lie
wherever the shared folder is (local, HDFS, object store).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botsift.session import scratch_path

MIN_REVISIT = 1000        # payloads of fewer bytes are always stored
SPLIT_BYTES = 8 << 20     # byte range of a reading task's unit
RANGES_PER_TASK = 4       # units of a reading task
CHUNK = 1 << 18           # bytes read at once
OUT_BYTES = 16 << 20      # payload bytes gathered before a batch is handed on

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # pages carry no fetch time

RECORD = ("file string, offset bigint, record_id string, record_type string, target_uri string, "
          "payload_digest string, refers_to string, payload binary")


def with_record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (UTF-8 bytes of the html; NULL is empty), digest
    (SHA-1, lower-case hex), record_type, refers_to.

    Of pages with equal payloads of at least ``min_revisit`` bytes the one
    with the largest page_id is the response; all with that page_id are, if
    it repeats, and all without an id, if none has one.
    """
    p = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    same = p.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    j = p.join(same.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))
    return j.select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
            "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: text/html"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records (see ``with_record_types``) as one archive per
    non-empty partition; returns the manifest (file, records, bytes).

    Each attempt writes a file of its own name and moves it into place at
    its end, so a lost or repeated task leaves no half archive under a final
    name and no record twice.  The manifest is computed when it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, base = pafs.FileSystem.from_uri(folder)
        final, attempt = f"{base}/part-{part:06d}.warc.gz", f"{base}/_attempt-{part}-{uuid.uuid4().hex}"
        out, n, size = None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(attempt)
                data = _member(_record(r["page_id"], r["url"], r["payload"], r["digest"], r["record_type"], r["refers_to"]))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            files.move(attempt, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "records": [n], "bytes": [size]},
                                             pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return records.mapInArrow(run, "file string, records bigint, bytes bigint")


def _header(block: bytes) -> dict[str, str] | None:
    """Fields of a header block, lower-case names; None if it is none."""
    lines = block.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return fields if {"warc-type", "warc-record-id"} <= fields.keys() and fields.get("content-length", "").isdigit() else None


class _Window:
    """Bytes of a file from a position on, read in chunks and let go behind."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.start, self.data = file, size, at, b""

    def at(self, pos: int, least: int = 1) -> bytes:
        """What is held from ``pos`` on, at least ``least`` bytes if the file has them."""
        if pos > self.start:
            self.data, self.start = self.data[pos - self.start:], pos
        while len(self.data) < least and self.start + len(self.data) < self.size:
            self.file.seek(self.start + len(self.data))
            self.data += self.file.read(CHUNK)
        return self.data


def _decode(win: _Window, pos: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``pos`` and where it ends; None if
    there is none, it is damaged, or it does not begin with a WARC header."""
    z, parts, known, at = zlib.decompressobj(31), [], False, pos
    while not z.eof:
        raw = win.at(at)
        if not raw:
            return None
        try:
            parts.append(z.decompress(raw))
        except zlib.error:
            return None
        at += len(raw) - len(z.unused_data)
        if not known and (z.eof or sum(map(len, parts)) >= 8):
            known = b"".join(parts)[:7] == b"WARC/1."
            if not known:
                return None
    return b"".join(parts), at


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, payload) of the records that start in [start, end)."""
    win, pos = _Window(file, size, start), start
    synced = False
    while pos < end:
        if not synced:
            data = win.at(pos, len(MAGIC))
            hit = data.find(MAGIC)
            if hit < 0:
                if pos + len(data) >= size:
                    return
                win.at(pos, len(data) + 1)  # magic may lie across two chunks
                if len(win.data) > CHUNK:
                    pos += len(data) - len(MAGIC) + 1
                continue
            pos += hit
            if pos >= end:
                return
        # a copy of the window's place, as a false candidate is left again
        look = _Window(file, size, pos)
        look.data = win.at(pos)
        got = _decode(look, pos)
        head = got and _header(got[0].partition(b"\r\n\r\n")[0])
        if not head:
            if pos >= size:
                return
            synced, pos = False, pos + 1
            continue
        content, after = got
        body = content.partition(b"\r\n\r\n")[2]
        yield pos, head, body[:int(head["content-length"])]
        synced, pos = True, after
        win = look


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the ``*.warc.gz`` files in a folder (RECORD).  The files
    are listed by Spark with their lengths, cut into byte ranges, and the
    ranges are dealt out to the tasks, a few to each, so that tasks grow in
    number with the bytes and not in size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    cuts = files.filter("length > 0").select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()),
                        ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
                        ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                files_, path = pafs.FileSystem.from_uri(r["path"])
                with files_.open_input_file(path) as f:
                    for at, head, body in records_in(f, r["length"], r["start"], min(r["start"] + split_bytes, r["length"])):
                        out.append({
                            "file": r["path"], "offset": at, "record_id": head["warc-record-id"],
                            "record_type": head["warc-type"], "target_uri": head.get("warc-target-uri"),
                            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "refers_to": head.get("warc-refers-to"), "payload": body})
                        held += len(body) + 500
                        if held > OUT_BYTES:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    tasks = max(spark.sparkContext.defaultParallelism, -(-cuts.count() // RANGES_PER_TASK))
    return cuts.repartition(tasks).mapInArrow(run, RECORD)


def page_id_of(col: str):
    """The page id in a record name of ``write_archives`` (NULL if it has none)."""
    return F.nullif(F.regexp_extract(F.col(col), "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("bigint")


def archive_pages(pages: DataFrame, min_revisit: int = MIN_REVISIT, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and digest_ok: the payload read back has the SHA-1 that its
    header declares (a revisit's payload is that of its response).

    Defined results: a NULL html is an empty payload; a NULL page_id comes
    back as NULL; rows that repeat a page_id are records of their own; a NULL
    url is empty.  Other columns are ignored; no pages give no archives.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    written = write_archives(with_record_types(pages, min_revisit), folder)
    if not (written.agg(F.sum("records")).first()[0] or 0):
        return spark.range(0).selectExpr("id AS page_id", "id AS payload_bytes", "'' AS payload_digest", "'' AS record_type",
                                         "id AS refers_to", "true AS digest_ok")
    r = read_archives(spark, folder, split_bytes).select(
        page_id_of("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("own_bytes"),
        F.sha1("payload").alias("own_digest"), "payload_digest", "record_type", page_id_of("refers_to").alias("refers_to"))
    stored = r.filter("record_type = 'response'")
    stored_as = stored.groupBy("page_id", "own_digest").agg(F.max("own_bytes").alias("stored_bytes"))
    again = r.filter("record_type = 'revisit'").join(
        stored_as.select(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("payload_digest"), "stored_bytes"),
        ["refers_to", "payload_digest"], "left")
    return stored.select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"),
                         "record_type", "refers_to", (F.col("own_digest") == F.col("payload_digest")).alias("digest_ok")
                         ).unionByName(again.select("page_id", F.col("stored_bytes").alias("payload_bytes"), "payload_digest",
                                                    "record_type", "refers_to", F.col("stored_bytes").isNotNull().alias("digest_ok")))
