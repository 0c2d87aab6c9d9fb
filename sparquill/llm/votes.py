"""SimHash votes with built-in functions: 64 bit counters in 32 sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW = (1 << 32) - 1


def simhash(terms: DataFrame, keys: list[str], hashed: str = "h", weight: str | None = None) -> DataFrame:
    """keys and the long `fingerprint` of the rows of terms that share them.

    Each row's hash votes on 64 bits, +weight where its bit is 1 and -weight where it is 0 (weight: a small
    non-negative int, 1 if not given); a bit of the fingerprint is 1 if its votes sum to over 0. A null hash
    has no vote, so keys without hashes get fingerprint 0. One sum counts bit k in its low half and bit
    k + 32 in its high half, which holds up to 2^31 weight for each key.
    """
    lanes = (1 << 32) | 1
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")

    def lane(k: int) -> Column:
        bits = F.shiftrightunsigned(hashed, k).bitwiseAND(F.lit(lanes))
        return F.sum(bits * w if weight else bits).alias(f"v{k}")

    total = F.sum(F.when(F.col(hashed).isNotNull(), w)).alias("all_votes")
    counted = terms.groupBy(*keys).agg(total, *[lane(k) for k in range(32)])

    def bit(k: int) -> Column:
        own = F.col(f"v{k % 32}")
        count = F.shiftrightunsigned(own, 32) if k >= 32 else own.bitwiseAND(F.lit(_LOW))
        one = F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")
        return F.when(count * 2 > F.col("all_votes"), one).otherwise(F.lit(0).cast("long"))

    return counted.select(*keys, reduce(Column.bitwiseOR, map(bit, range(64))).alias("fingerprint"))


def hex64(c: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return (F.lit(64) - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)
