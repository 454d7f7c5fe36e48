"""In-memory samples (S6) and seeded fixed-size sampling."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import READING

# Prime modulus and multipliers of the arithmetic row hash.  It is a function
# of the key and the seed, so it is stable under any repartitioning, and any
# SQL engine can evaluate it.
HASH_MOD = 2147483647
HASH_MUL = (48271, 69621)


def row_hash(key, seed: int = 42) -> Column:
    """Seeded pseudo-random order key of 62 bits (long) for a non-negative
    integer key; ties are broken by the key itself.  The seed picks the
    multipliers of two rounds with a square between them, so orders of
    different seeds are unrelated."""
    k = (F.col(key) if isinstance(key, str) else key).cast("long")
    m1, m2 = pow(HASH_MUL[0], 2 * seed + 1, HASH_MOD), pow(HASH_MUL[1], 2 * seed + 3, HASH_MOD)
    mod = F.lit(HASH_MOD).cast("long")
    first = F.pmod(F.pmod(k, mod) * m1 + seed % HASH_MOD, mod)
    high = F.pmod(first * first + F.call_function("div", k, mod), mod)
    low = F.pmod(high * m2 + first, mod)
    return high * F.lit(2147483648).cast("long") + low


def readings_frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """A frame from an in-memory list of (tds, turbidity, ph)."""
    return spark.createDataFrame([tuple(float(x) for x in r) for r in rows], READING)


def sample_n(df: DataFrame, n: int, key: str = "reading_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, stable under
    repartitioning (an ordered limit on a hash of the key; each task keeps
    only its own top ``n``, so at most n x tasks rows meet in the merge)."""
    return (df.withColumn("_h", row_hash(key, seed))
            .orderBy("_h", key).limit(n).drop("_h"))
