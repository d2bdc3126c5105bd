"""64-bit SimHash by packed vote counters, DataFrame functions only.

Every term's XXH64 (seed 42) votes on 64 bits. Two counters of 32 bits share a long, so 32 sums hold all votes,
inside one partial hash aggregation: a document's counters leave the task as 33 longs, never its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 32
_PAIR = 0x100000001
_LOW = 0xFFFFFFFF


def shingle(w: Column, i: Column, n: Column, k: int) -> Column:
    """The i-th shingle of k words, space-joined; of fewer words the whole sequence; null without words."""
    if k == 1:
        return F.get(w, i)
    return F.when(n >= k, F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))).when(n > 0, F.array_join(w, " "))


def votes(df: DataFrame, keys: list[str], w: str, k: int) -> DataFrame:
    """One row for each combination of ``keys``: ``_n`` terms and the counters ``_v0``.. ``_v31``."""
    n = F.size(w)
    terms = df.select(*keys, w, F.explode(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).alias("_i"))
    hashed = terms.select(*keys, F.when(n > 0, F.xxhash64(shingle(F.col(w), F.col("_i"), n, k))).alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(_PAIR)).alias(f"_v{j}") for j in range(LANES)]
    return hashed.groupBy(*keys).agg(F.count("_h").alias("_n"), *sums)


def fingerprint() -> Column:
    """A bit is 1 if more than half of the terms set it; without terms all are 0."""
    bits = F.lit(0).cast("long")
    for j in range(LANES):
        v = F.coalesce(F.col(f"_v{j}"), F.lit(0))
        bits = bits.bitwiseOR(F.when(2 * v.bitwiseAND(_LOW) > F.col("_n"), F.lit(1 << j)).otherwise(0))
        high = (1 << (j + 32)) - ((1 << 64) if j == 31 else 0)
        bits = bits.bitwiseOR(F.when(2 * F.shiftrightunsigned(v, 32) > F.col("_n"), F.lit(high).cast("long")).otherwise(0))
    return bits


def as_hex(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
