"""Last-write-wins de-duplication (the reference's map.put semantics).

Implemented as ``max_by(struct(row), seq)`` grouped by key: an aggregate with
partial (map-side) combination, so a key with a third of all rows is reduced
before the shuffle instead of being sorted in one task as a row_number
window would require.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """One row per key: the row with the largest ``seq``."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return g.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])
