"""Word rules and hashing shared by the text operators.

Two word rules are used.  *Spaced* words are maximal runs of characters
other than space and TAB..CR; ``bytes.split()`` follows exactly this rule.
*Alphanumeric* words are maximal runs of ASCII digits, ASCII letters and
non-ASCII characters; only A-Z is lower-cased.
"""

from __future__ import annotations

import string

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # separators, once A-Z are lower case

CACHE_WORDS = 200_000  # hashed words a Python worker remembers (a speed setting only)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, every other character untouched.  ``lower`` does the same
    on pure ASCII, and is much faster there than ``translate``."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def alnum_words(col: Column) -> Column:
    """Lower-cased alphanumeric words of a text, in order; NULL gives none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(col, F.lit(""))), NOT_ALNUM), "")


def spaced_count(col: Column) -> Column:
    """Number of spaced words; NULL gives 0."""
    return F.coalesce(F.regexp_count(col, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembering up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * _MUL2
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hash of every window of k consecutive word hashes; a
    shorter sequence is one window (salted by its length)."""
    if len(h) == 0:
        return h
    width = min(k, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        acc = mix(acc * _MUL + h[j:j + n])
    return acc
