"""Membership filters of a fixed size, built by aggregation and broadcast to Python workers.

A filter answers "maybe in" or "surely not in". Its size is ``bits / 8`` bytes whatever the number
of values, so it can always be broadcast; more values only mean more "maybe", never a wrong result.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 26
_SEGMENT = 32_768  # bits of one bitmap that bitmap_construct_agg builds


def bits_for(count: int) -> int:
    """Bits for about ``count`` values: 64 each or more, but never over ``BITS``."""
    return min(BITS, max(1 << 20, 1 << (64 * count).bit_length()))


def build(values: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """Broadcast filter of a long column: at most bits / 32768 rows of 4 KB come to the driver."""
    place: Column = F.pmod(F.col(column), F.lit(bits)) + 1
    rows = (
        values.filter(F.col(column).isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("segment"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
        .collect()
    )
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for row in rows:
        at = (row.segment - 1) * _SEGMENT // 8
        packed[at : at + _SEGMENT // 8] = np.frombuffer(row.bitmap, dtype=np.uint8)
    return values.sparkSession.sparkContext.broadcast(packed)


def maybe(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each 64-bit value, whether it may have been put in."""
    place = values.astype(np.uint64) & np.uint64(len(packed) * 8 - 1)
    return (packed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
