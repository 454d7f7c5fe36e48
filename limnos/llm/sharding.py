"""Sharding by a two-pass external shuffle.

Pass 1 scatters records with seeded hashes: the shard is the rendezvous choice
of the id (the shard whose seeded hash with the id is largest, so one more
shard takes rows only into itself), and within a shard a second seeded hash
picks a bucket of about ``bucket_bytes``.  Pass 2 runs a seeded Fisher-Yates
shuffle over each bucket and gives each record its slot; the buckets of a
shard follow each other, so slots run from 0 without gaps.

The scatter is the only time the texts are shuffled.  Pass 2 streams a bucket:
only its permutation (8 bytes a row) is held, never its texts, so repeated
rows that all hash into one bucket stay cheap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import extended, text_hash, without

SEED = 42
BUCKET_BYTES = 8 << 20
LAW = "key"


def shard_of(key, n_shards: int, seed: int = SEED):
    """Rendezvous choice among ``n_shards``: depends on the key and the count only."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    scores = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s"))
                       for s in range(n_shards)])
    return F.array_max(scores)["s"]


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """The slot of each of n records: numpy's seeded in-place Fisher-Yates."""
    slot = np.arange(n, dtype=np.int64)
    np.random.Generator(np.random.PCG64(seed)).shuffle(slot)
    return slot


def _permute(seed: int):
    def run(batches):
        held, perm = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            shard, bucket, n, base, pos = (b.column(f"__lm_{c}").to_numpy(zero_copy_only=False)
                                           for c in ("shard", "bucket", "n", "base", "pos"))
            slot = np.empty(b.num_rows, dtype=np.int64)
            cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(bucket) != 0)) + 1
            edges = [0, *cut.tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                key = (int(shard[lo]), int(bucket[lo]))
                if key != held:
                    held, perm = key, fisher_yates(int(n[lo]), [seed, *key])
                slot[lo:hi] = base[lo:hi] + perm[pos[lo:hi]]
            keep = [c for c in b.schema.names if not c.startswith("__lm_")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(shard), pa.array(slot)],
                                             [*keep, "shard", "slot"])
    return run


def shuffle_to_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                      seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (long, gapless
    from 0 in a shard); input columns named so are replaced.

    Each row gets one place, repeated rows too.  Equal ids (and all null ids)
    share a shard, as the law ``key`` asks.  Null and empty texts are rows
    like others.  An empty table gives no rows.  The result depends on ids,
    texts and the seed, not on how the input is partitioned (rows equal in id
    and text are interchangeable).
    """
    df = without(df, "shard", "slot")
    key = F.col(id_col)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    narrow = df.select(shard_of(key, n_shards, seed).alias("s"), size.alias("z"),
                       F.xxhash64(F.lit(seed + 1), key, text_hash(F.col(text_col))).alias("h"))
    heaviest = narrow.groupBy("s").agg(F.sum("z").alias("z")).agg(F.max("z")).first()[0] or 1
    n_buckets = int(-(-heaviest // bucket_bytes))
    bucket = F.pmod(F.col("h"), F.lit(n_buckets)).cast("int")
    counts = narrow.groupBy("s", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("s").alias("__lm_shard"), F.col("b").alias("__lm_bucket"), F.col("n").alias("__lm_n"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__lm_base"))
    names = df.columns
    scattered = (df.select("*", shard_of(key, n_shards, seed).alias("__lm_shard"),
                           F.xxhash64(F.lit(seed + 1), key, text_hash(F.col(text_col))).alias("__lm_h"))
                 .withColumn("__lm_bucket", F.pmod("__lm_h", F.lit(n_buckets)).cast("int"))
                 .join(counts, ["__lm_shard", "__lm_bucket"]))
    place = Window.partitionBy("__lm_shard", "__lm_bucket").orderBy("__lm_h", F.col(id_col).asc_nulls_last())
    placed = scattered.withColumn("__lm_pos", F.row_number().over(place).cast("long") - 1) \
        .select(*[scattered[c] for c in names], "__lm_shard", "__lm_bucket", "__lm_n", "__lm_base", "__lm_pos")
    return placed.mapInArrow(_permute(seed), extended(df.schema, shard=T.IntegerType(), slot=T.LongType()))


def write_shards(df: DataFrame, path: str) -> None:
    """Write placed rows: a folder ``shard=N`` for each shard, rows of a file in slot order."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
