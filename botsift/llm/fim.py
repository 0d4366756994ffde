"""Fill-in-the-middle transformation of whole texts, as a pyarrow.compute pipeline.

A text is cut into units (a word with the white space before it; white space
at the end is a unit of its own).  Two hash-drawn borders make three pieces of
them: prefix, middle and suffix.  A batch of texts is one pipeline of Arrow
kernels: split into list arrays of units, flatten with parent indices, compute
each unit's ordinal, filter by role, rebuild lists and join the pieces.  Units
are cut on UTF-8 bytes, where the byte 0xFF never occurs and marks the cuts.

Rows stay where they are: there is no shuffle, draws are hashes of the seed
and the id, and a batch is worked off in slices of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = "42"
RATE = 50         # percent of the texts that are transformed
SPM_RATE = 80     # percent of those in the suffix-first form
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 4 << 20   # text bytes that one run of the kernels takes (more only if one text is longer)

_UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
_CUT = b"\xff"


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32: the first 8-digit groups of the hex SHA-256
    of ``seed:id`` (a NULL id is empty)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _mod(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _piece(units: pa.Array, sizes: pa.Array, role: pa.Array, want: int) -> pa.Array:
    """Per row: its units of one role, joined.  ``sizes`` is how many a row has."""
    values = pc.filter(units, pc.equal(role, want))
    ends = pc.cumulative_sum(pc.cast(sizes, pa.int64()))
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), pa.scalar(b"", pa.large_binary()))


def split_units(text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Units of UTF-8 texts (large binary, no NULL): all units, the row each
    belongs to, its ordinal in the row, and the rows' numbers of units."""
    cut = pc.split_pattern(pc.replace_substring_regex(text, _UNIT, rb"\1" + _CUT), _CUT)
    row = pc.list_parent_indices(cut)
    first = pc.subtract(pa.array(cut.offsets.slice(0, len(cut))), cut.offsets[0])  # offsets of a sliced list need not start at 0
    at = pc.subtract(pa.array(np.arange(len(row))), pc.take(pc.cast(first, pa.int64()), row))
    n = pc.subtract(pc.cast(pc.list_value_length(cut), pa.int64()), 1)  # every list ends with an empty rest
    real = pc.less(at, pc.take(n, row))
    return pc.filter(pc.list_flatten(cut), real), pc.filter(row, real), pc.filter(at, real), n


def infill(text: pa.Array, h: list[pa.Array], rate: int = RATE, spm_rate: int = SPM_RATE,
           sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> dict[str, pa.Array]:
    """The transformation of a batch of texts (strings, no NULL): n, form,
    output, prefix_chars and middle_chars (NULL if plain)."""
    raw = pc.cast(text, pa.large_binary())
    units, row, at, n = split_units(raw)
    a, b = (_mod(x, pc.add(n, 1)) for x in h[:2])
    lo, hi = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    role = pc.if_else(pc.less(at, pc.take(lo, row)), 0, pc.if_else(pc.less(at, pc.take(hi, row)), 1, 2))
    pre, mid, suf = (_piece(units, size, role, i)
                     for i, size in enumerate((lo, pc.subtract(hi, lo), pc.subtract(n, hi))))

    taken = pc.equal(pc.binary_length(raw), 0)
    for s in sentinels:
        taken = pc.or_(taken, pc.match_substring(raw, s.encode()))
    plain = pc.or_(taken, pc.greater_equal(_mod(h[2], 100), rate))
    spm = pc.less(_mod(h[3], 100), spm_rate)
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in sentinels)
    empty = pa.scalar(b"", pa.large_binary())
    out = pc.case_when(
        pc.make_struct(plain, spm), raw,
        pc.binary_join_element_wise(s, suf, p, pre, m, mid, empty),
        pc.binary_join_element_wise(p, pre, s, suf, m, mid, empty))
    chars = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(pc.cast(x, pa.large_string())), pa.int64()))
    return {"n": n, "form": pc.case_when(pc.make_struct(plain, spm), "plain", "spm", "psm"),
            "output": pc.cast(pc.cast(out, pa.large_string()), pa.string()), "prefix_chars": chars(pre), "middle_chars": chars(mid)}


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
                   sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``_row`` (the columns ``keep``, all by default),
    n (units), form ('plain', 'psm' or 'spm'), output (the training text),
    prefix_chars and middle_chars (code points; NULL if plain).

    Defined results: a NULL text is an empty one, and stays plain; so does a
    text that has a sentinel in it.  A NULL id is drawn as an empty one; rows
    of one id are drawn alike.  Bytes that are not UTF-8 are read as U+FFFD.
    An empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.make_valid_utf8(F.col("text").cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), text.alias("text"),
                       *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    schema = T.StructType([rows.schema["_row"], *T._parse_datatype_string(
        "n bigint, form string, output string, prefix_chars bigint, middle_chars bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text", SLICE_BYTES):
                done = infill(part.column("text"), [part.column(f"h{i}") for i in range(4)], rate, spm_rate, sentinels)
                yield pa.RecordBatch.from_arrays([part.column("_row"), *done.values()], names=["_row", *done])

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of, rebuilt from output and form
    alone (a text with a sentinel in it is always plain)."""
    piece = F.split(output, "|".join(re.escape(s) for s in sentinels))
    at = lambda i: F.get(piece, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(
        form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
