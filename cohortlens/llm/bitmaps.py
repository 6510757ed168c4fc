"""Bitmaps of fixed size over hash values, to keep rows out of a shuffle that cannot find a partner.

A bitmap only saves work.  It lets all wanted rows pass and some others; with very many wanted
values it lets everything pass, and the join behind it decides as before.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_bitmap(df: DataFrame, key: Column, bits: int) -> Broadcast:
    """A broadcast bitmap of the leading ``bits`` bits of a 64-bit key.

    The bits are put together in words of 64 before they reach the driver, 2 ** (bits - 6) at most.
    """
    bucket = F.shiftrightunsigned(key, 64 - bits)
    words = df.select(bucket.alias("x")).select(
        F.shiftright("x", 6).alias("word"),
        F.expr("shiftleft(1L, cast(x & 63 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be wanted."""
    bits = len(bitmap).bit_length() + 5
    bucket = keys.view(np.uint64) >> np.uint64(64 - bits)
    word = bitmap[(bucket >> np.uint64(6)).astype(np.int64)]
    return (word >> (bucket & np.uint64(63))) & np.uint64(1) != 0
