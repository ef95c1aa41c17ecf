"""Bit filters of a fixed size, built by Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mixed(h: np.ndarray, probe: int) -> np.ndarray:
    """Another 64-bit hash for each probe (shifts and odd multipliers, wrapping)."""
    h = h ^ (h >> np.uint64(31 + probe))
    h = h * np.uint64(0x9E3779B97F4A7C15 + 2 * probe)
    return h ^ (h >> np.uint64(32))


def probes(h: np.ndarray, bits: int, k: int) -> list[np.ndarray]:
    return [mixed(h, p) >> np.uint64(64 - bits) for p in range(k)]


def bit_rows(slots: DataFrame, slot: Column) -> DataFrame:
    """bucket, bitmap: the set of slots as bitmaps of 32,768 bits, so at most 2**bits / 32,768 rows of 4 KB."""
    return slots.groupBy(F.bitmap_bucket_number(slot + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bitmap"))


def gathered(rows: DataFrame, bits: int) -> np.ndarray:
    """The filter as bytes on the driver: 2**(bits - 3) of them, whatever the data."""
    out = np.zeros(max(1 << bits, 1 << 15) >> 3, dtype=np.uint8)
    for r in rows.collect():
        start = (r["bucket"] - 1) * 4096
        out[start:start + 4096] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return out


def holds(filter_: np.ndarray, h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """Which hashes may be in the filter."""
    found = np.ones(len(h), dtype=bool)
    for slots in probes(h, bits, k):
        found &= (filter_[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found
