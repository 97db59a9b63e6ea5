"""Hashed character n-grams of words, vectorised over the bytes of many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import seeds

#: Letters: a-z (A-Z folded) and all bytes of other scripts; the rest ends a word (0).
FOLD = np.zeros(256, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)

_VALUE = seeds(256, 401)
_STEP = seeds(8, 402) | np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice of documents. ``out``: folded bytes with a 0 around every document; ``word``: the number of
    each letter's word; ``doc``: each word's document; ``starts``/``ends`` in ``out``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        docs, lens = len(offs) - 1, np.diff(offs)
        self.docs = docs
        self.out = np.zeros(len(buf) + docs + 1, np.uint8)
        self.out[np.arange(len(buf)) + np.repeat(np.arange(1, docs + 1), lens)] = FOLD[buf]
        self.letter = self.out != 0
        start = self.letter.copy()
        start[1:] &= ~self.letter[:-1]
        end = self.letter.copy()
        end[:-1] &= ~self.letter[1:]
        self.word = np.cumsum(start) - 1
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offs + np.arange(docs + 1), self.starts, "right") - 1
        self.n = len(self.starts)

    def grams(self, low: int, high: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size from ``low`` (at least 2) to ``high``: (word number, bucket) of every n-gram that lies in a word
        with its two ends, by position."""
        hashed = _VALUE[self.out]
        upto = np.concatenate(([0], np.cumsum(self.letter)))
        for n in range(2, high + 1):
            if len(self.out) < n:
                return
            hashed = hashed[:-1] + _VALUE[self.out[n - 1 :]] * _STEP[n - 1]
            if n < low:
                continue
            m = len(hashed)
            if n == 2:
                at = np.flatnonzero(self.letter[:m] | self.letter[1 : m + 1])
            else:
                at = np.flatnonzero(upto[n - 1 : n - 1 + m] - upto[1 : 1 + m] == n - 2)
            h = hashed[at]
            h = ((h ^ (h >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - bits)
            # letters only count words from their start on, so the byte after a boundary has the number wanted
            yield self.word[np.where(self.letter[at], at, at + 1)], h.astype(np.int64)


def remainder(column: str, by: int):
    """crc32 of a number as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


#: A sample may be split by so many different keys.
MOST_KEYS = 1000


def hash_sample(df: DataFrame, key: str, id_col: str, rows: int) -> DataFrame:
    """The rows of each value of ``key`` with the lowest hashes of ``id_col``: about ``rows`` of them (all if there are
    fewer); null keys are left out. More than MOST_KEYS values are an error. However often an id is repeated, there are
    no more than four times as many rows as are wanted."""
    got = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).limit(MOST_KEYS + 1).collect()
    if len(got) > MOST_KEYS:
        raise ValueError(f"{key} has more than {MOST_KEYS} values")
    counts = {r[key]: r["n"] for r in got}
    if not counts:
        return df.limit(0)
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))))
    spot = F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1_000_000)) / 1_000_000
    return df.filter(F.col(key).isNotNull() & (spot < F.element_at(share, F.col(key)))).limit(4 * sum(min(rows, n) for n in counts.values()) + 1000)
