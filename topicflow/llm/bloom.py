"""Bloom filters of a fixed greatest size, built and probed on the cluster.

A filter is a table of 4 KB bitmaps, one for each run of 32,768 bits that has a bit set,
so its size never passes ``MAX_BITS`` however large the input is.  Beyond that it only
lets more rows through: every use is followed by an exact join or aggregate.
Keys are 64-bit hashes; ``key & (bits - 1)`` is the bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MIN_BITS = 1 << 20
#: 16 MB: the bound of what is broadcast
MAX_BITS = 1 << 27
PAGE = 32_768


def filter_bits(keys: int, most: int = MAX_BITS) -> int:
    """Bits (a power of two) for so many keys."""
    return min(most, max(MIN_BITS, 1 << int(keys * BITS_PER_KEY).bit_length()))


def build(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``(page, bitmap)`` of the bits that ``key`` sets."""
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    return keys.select(at.alias("at")).groupBy(F.expr(f"at div {PAGE}").alias("page")).agg(
        F.bitmap_construct_agg(F.col("at") % PAGE).alias("bitmap")
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until they are no column of ``df`` (upper and lower case count as equal)."""
    taken = {c.lower() for c in df.columns}
    longest = max((len(c) for c in taken), default=0)
    return [n if n.lower() not in taken else n.ljust(longest + 1, "_") for n in names]


def probe(df: DataFrame, key: Column, pages: DataFrame, bits: int, out: str) -> DataFrame:
    """``df`` with boolean ``out``: whether the bit of ``key`` is set.  The pages (at most 16 MB) are broadcast."""
    at, page, bitmap = free_names(df, f"{out}_at", f"{out}_page", f"{out}_bitmap")
    small = F.broadcast(pages.select(F.col("page").alias(page), F.col("bitmap").alias(bitmap)))
    byte = f"cast(conv(hex(substring({bitmap}, cast(({at} % {PAGE}) div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"getbit({byte}, cast({at} % 8 as int)) = 1")
    looked = df.withColumn(at, key.bitwiseAND(F.lit(bits - 1)))
    joined = looked.join(small, F.expr(f"{at} div {PAGE}") == F.col(page), "left")
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(out))


@dataclass
class TaskFilter:
    """A filter in the Python workers' memory."""

    shared: object
    bits: int

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.uint64) & np.uint64(self.bits - 1)
        bitmap = self.shared.value
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def share(spark: SparkSession, pages: DataFrame, bits: int) -> TaskFilter:
    """Send the pages (at most ``bits / 8`` bytes) to all workers."""
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in pages.collect():
        part = np.frombuffer(row["bitmap"], np.uint8)
        start = row["page"] * (PAGE // 8)
        bitmap[start : start + part.size] = part[: bitmap.size - start]
    return TaskFilter(spark.sparkContext.broadcast(bitmap), bits)
