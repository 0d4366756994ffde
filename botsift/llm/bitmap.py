"""A bitmap of names that filters rows on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botsift.session import materialize

BITMAP_BITS = 1 << 27


def maybe_in(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows whose long ``col`` may be in that of ``ids``, filtered on the
    map side before they are shuffled.  The ids set bits of one bitmap of
    fixed size (16 MB in all, so it can be broadcast); other rows with the
    same bit pass too and are left to the join that follows.
    """
    return maybe_held(rows, col, ids, "held", "inner").filter("held").select(*rows.columns)


def maybe_held(rows: DataFrame, col: str, ids: DataFrame, name: str, how: str = "left") -> DataFrame:
    """``rows`` with a boolean ``name``: false only if the long ``col`` is
    surely not in that of ``ids`` (NULLs are not).  An inner join leaves out some of those."""
    bit = F.pmod(F.col(col), F.lit(BITMAP_BITS))
    bucket = F.shiftright(bit, 15)  # a bitmap_construct_agg value holds 32,768 bits
    maps = materialize(ids.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("bits")), "bitmap")
    held = "shiftright(cast(conv(hex(substring(bits, at div 8 + 1, 1)), 16, 10) AS INT), CAST(at % 8 AS INT)) & 1 = 1"
    x = rows.withColumns({"bucket": bucket, "at": F.pmod(bit, F.lit(32768)).cast("int")})
    return x.join(F.broadcast(maps), "bucket", how).select(*rows.columns, F.coalesce(F.expr(held), F.lit(False)).alias(name))
