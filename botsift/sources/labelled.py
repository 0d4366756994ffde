"""Labelled-account file: one line per account, "<label> <user_id> <status_id>*".

Parsing is column expressions over ``spark.read.text`` (split, try_cast,
transform), so it runs in the scan stage with no Python.  Malformed lines
either fail the job (``failfast``, like the reference, which exits) or are
routed to a quarantine DataFrame with a reason (``quarantine``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = ("quarantine", "failfast")
LISTED_USED = 10  # statuses used per labelled account (fixed value of the reference)


def _tokens(value: Column) -> Column:
    # Trailing blanks are dropped (as a Java String.split would); inner empty
    # tokens are kept so they can be reported.
    return F.split(F.regexp_replace(value, " +$", ""), " ")


def _reason(tokens: Column) -> Column:
    ids = F.slice(tokens, 2, 1 << 30)
    return (
        F.when(F.size(tokens) == 1, F.when(tokens[0] == F.lit(""), F.lit("blank")).otherwise(F.lit("missing_id")))
        .when(F.exists(tokens, lambda t: t == F.lit("")), F.lit("empty_token"))
        .when(F.exists(ids, lambda t: t.try_cast("bigint").isNull()), F.lit("non_numeric"))
    )


def line_order() -> Column:
    """A sortable key giving the file order of lines read by spark.read.text.

    (file path, start of the split, record number inside the partition):
    splits are read front to back and the low 33 bits of
    monotonically_increasing_id count records within a partition, so the key
    follows the order of lines in each file however splits are packed.
    """
    rec = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        rec.alias("rec"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse a DataFrame with a ``value`` text column.

    Returns columns: value, reason (NULL when well-formed), label, user_id,
    status_ids ARRAY<BIGINT>, and ``line`` (file order, see line_order) when
    the input still carries the file metadata.
    """
    toks = _tokens(F.col("value"))
    order = [line_order().alias("line")] if _has_metadata(lines) else []
    return lines.select(
        *order,
        "value",
        _reason(toks).alias("reason"),
        toks[0].alias("label"),
        F.get(toks, 1).try_cast("bigint").alias("user_id"),
        F.transform(F.slice(toks, 3, 1 << 30), lambda t: t.try_cast("bigint")).alias("status_ids"),
    )


def _has_metadata(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path")
        return True
    except Exception:  # noqa: BLE001 - not a file scan
        return False


def read_labelled(spark: SparkSession, path: str, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Read a labelled-account file.

    Returns (accounts, quarantine).  ``accounts`` has line (file order),
    label, user_id, status_ids; ``quarantine`` has reason, the raw line and
    its location (file, split start, record within the split).  In ``failfast``
    mode the first malformed line raises when the data is computed.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parsed = parse_lines(spark.read.text(path))
    good = parsed.filter(F.col("reason").isNull())
    if mode == "failfast":
        # A filter (not a projection) so the check cannot be pruned away.
        msg = F.concat(F.lit("malformed labelled line ("), F.col("reason"), F.lit("): "), F.col("value"))
        good = parsed.filter(F.when(F.col("reason").isNotNull(), F.raise_error(msg)).otherwise(F.lit(True)))
    accounts = good.select("line", "label", "user_id", "status_ids")
    # where the line is: (file, split start, record within the split)
    quarantine = parsed.filter(F.col("reason").isNotNull()).select(
        "reason", F.col("value").alias("line"), F.col("line").alias("location"))
    return accounts, quarantine


def dedupe_accounts(accounts: DataFrame, keep_line: bool = False) -> DataFrame:
    """One row per account id: the last line of the file wins (map.put)."""
    from botsift.operators.dedupe import last_wins

    one = last_wins(accounts, "user_id", "line")
    return one if keep_line else one.drop("line")


def first_listed(accounts: DataFrame, n: int = LISTED_USED) -> DataFrame:
    """Keep the first n listed status ids of each account (file order)."""
    return accounts.withColumn("status_ids", F.slice("status_ids", 1, n))


def write_lines(lines: DataFrame, path: str) -> str:
    lines.select("value").write.mode("overwrite").text(path)
    return path
