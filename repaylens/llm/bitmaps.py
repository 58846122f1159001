"""A set of hashes as a bitmap of bounded size, built by Spark and broadcast.

A bitmap answers "not in the set" for certain and "in the set" with some error, which
callers only use to leave out work that cannot matter. It has some 16 bits for each hash,
and never more than ``2 ** MOST_BITS``, 16 MB.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 15, 27


def place(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each 64-bit number, whose high and low bits say most."""
    h = hashes.astype(np.uint64)
    return ((h ^ (h >> np.uint64(33))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def contains(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = place(hashes, (8 * len(bitmap)).bit_length() - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def broadcast_bitmap(hashes: DataFrame, rows: int) -> Broadcast:
    """Broadcast the bitmap of the one column of longs of ``hashes``, which has about so many ``rows``.

    Spark's own bitmap aggregate sets the bits, on the map side first.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * rows).bit_length()))
    h = F.col(hashes.columns[0])
    at = hashes.select(h.bitwiseXOR(F.shiftrightunsigned(h, 33)).bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    # Spark counts places from 1 and puts 2^15 of them into a bucket
    parts = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")
    )
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << 15) // 8
    for row in parts.collect():  # at most 2^(bits-15) rows of 4 KB
        start = (row["bucket"] - 1) * size
        bitmap[start : start + size] = np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def opened(shared: Broadcast) -> np.ndarray:
    return np.frombuffer(shared.value, np.uint8)
