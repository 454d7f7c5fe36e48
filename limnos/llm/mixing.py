"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source is a stream of documents in seeded order, cut into equal blocks of
``BLOCK`` words; a document belongs to the block in which it starts, so blocks
hold whole documents.  Target words per source follow the weights, stopped at
``max_repeat`` times the source with the excess shared again.  The mix has a
fixed number of blocks; the highest quotients target / (2 q + 1) give them to
the sources, for each output shard in turn (the method is house-monotone, so a
source's quotas per shard are integers that add up to its quota).  A shard gets
its quota of each source as the next blocks of that stream, which after its end
starts again.  A source that whole blocks would miss by more than ``SLACK`` of
its target gets a last block of the words that are left over or missing.

No other source's size sets a block.  Only the document at the end of a source's
words can be cut, once, and it is not (dropped or taken whole, what is nearer)
where that moves the source by ``SLACK`` of its target at most.

A source's stream position is a two-level prefix sum: sums over about the
square root of its rows in hash buckets, then within a bucket, so a source
with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import heapq
import math
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, extended, slices, text_hash, texts, without, word_counts

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 1024           # words of a block
SLACK = 1 / 512        # share of its target by which a source may miss it
N_SHARDS = 16
SEED = 42
MAX_SOURCES = 50_000   # most sources a mix may have: bounds what the driver holds


def targets(sizes: list[int], weights: list[float], max_repeat: float = MAX_REPEAT) -> list[float]:
    """Words per source: all words shared by weight, none above ``max_repeat``
    times its size, the excess reshared by weight until none is above."""
    out = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in sorted(free) if left * weights[i] / w > max_repeat * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(max_repeat * sizes[i])
            free.discard(i)
        left -= sum(out[i] for i in over)
    return out


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients share / (2 q + 1); ties to the earlier source."""
    total = sum(shares)
    if total <= 0:
        return [0] * len(shares)
    q = [int(seats * s / total) if s > 0 else 0 for s in shares]
    gain = [(-s / (2 * q[i] + 1), i) for i, s in enumerate(shares) if s > 0]
    heapq.heapify(gain)
    lose = [(s / (2 * q[i] - 1), -i) for i, s in enumerate(shares) if q[i] > 0]
    heapq.heapify(lose)

    def put(i: int, by: int) -> None:
        q[i] += by
        heapq.heappush(gain, (-shares[i] / (2 * q[i] + 1), i))
        if q[i]:
            heapq.heappush(lose, (shares[i] / (2 * q[i] - 1), -i))

    def best():
        while gain[0][0] != -shares[gain[0][1]] / (2 * q[gain[0][1]] + 1):
            heapq.heappop(gain)
        return gain[0]

    def worst():
        while lose and (q[-lose[0][1]] == 0 or lose[0][0] != shares[-lose[0][1]] / (2 * q[-lose[0][1]] - 1)):
            heapq.heappop(lose)
        return lose[0] if lose else None

    have = sum(q)
    while have < seats:
        put(best()[1], 1)
        have += 1
    while have > seats:
        put(-worst()[1], -1)
        have -= 1
    while (low := worst()) and -best()[0] > low[0]:      # one seat moves to a higher quotient
        i, j = best()[1], -low[1]
        put(j, -1)
        put(i, 1)
    return q


def plan_mix(sources: list, sizes: list[int], weights=WEIGHTS, max_repeat: int = MAX_REPEAT,
             n_shards: int = N_SHARDS) -> tuple[int, list[dict]]:
    """(words of a block, one dict per source) for sources in mixing order:
    target, whole epochs and words of the epoch that is not whole, blocks per
    shard (``quotas``) and up to the end of each (``upto``)."""
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], max_repeat)
    blocks = round(sum(goal) / BLOCK)
    upto = [sainte_lague(goal, blocks * (s + 1) // n_shards) for s in range(n_shards)]
    out = []
    for i, (src, size, g) in enumerate(zip(sources, sizes, goal)):
        words = upto[-1][i] * BLOCK
        words = min(words if abs(words - g) <= g * SLACK else round(g), max_repeat * size)
        out.append({"source": src, "source_size": size, "target": g, "epochs": words // size if size else 0,
                    "rest": words % size if size else 0, "upto": [u[i] for u in upto], "spare": i % n_shards,
                    "quotas": [u[i] - (upto[s - 1][i] if s else 0) for s, u in enumerate(upto)]})
    return BLOCK, out


def _size_batches(batches):
    for b in slices(batches, "__lm_text"):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(word_counts(b.column("__lm_text")))],
                                         [*b.schema.names, "__lm_size"])


def _sized(df: DataFrame, text_col: str) -> DataFrame:
    d = df.withColumn("__lm_text", F.col(text_col))
    return d.mapInArrow(_size_batches, extended(d.schema, __lm_size=T.LongType())).drop("__lm_text")


def _place(rows: DataFrame, id_col: str, source_col: str, weights, max_repeat: int, n_shards: int, seed: int):
    """Rows (with __lm_size, __lm_h) and their stream position and source plan."""
    per = rows.groupBy(F.col(source_col).alias("s")).agg(F.sum("__lm_size").alias("z"), F.count(F.lit(1)).alias("n")) \
              .limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources in {source_col}")
    per.sort(key=lambda r: (r["s"] is None, r["s"] if r["s"] is not None else ""))
    _, plan = plan_mix([r["s"] for r in per], [r["z"] for r in per], weights, max_repeat, n_shards)
    n_buckets = max(1, math.isqrt(max((r["n"] for r in per), default=1)))
    spark = rows.sparkSession
    kind = rows.schema[source_col].dataType.simpleString()
    side = spark.createDataFrame(
        [(p["source"], p["source_size"], p["target"], p["epochs"], p["rest"], p["upto"], p["spare"]) for p in plan],
        f"__lm_src {kind}, __lm_total long, __lm_target double, __lm_epochs long, __lm_rest long, __lm_upto array<long>, __lm_spare int")
    placed = rows.withColumn("__lm_b", F.pmod(F.xxhash64(F.lit(seed), "__lm_h", F.col(id_col)), F.lit(n_buckets)).cast("int")) \
                 .withColumn("__lm_o", F.xxhash64(F.lit(seed + 1), "__lm_h", F.col(id_col)))
    before = Window.partitionBy("__lm_s").orderBy("__lm_bb").rowsBetween(Window.unboundedPreceding, -1)
    offs = (placed.groupBy(F.col(source_col).alias("__lm_s"), F.col("__lm_b").alias("__lm_bb"))
            .agg(F.sum("__lm_size").alias("z"))
            .select("__lm_s", "__lm_bb", F.coalesce(F.sum("z").over(before), F.lit(0)).alias("__lm_base")))
    names = rows.columns
    inner = Window.partitionBy(source_col, "__lm_b").orderBy("__lm_o", F.col(id_col).asc_nulls_last(), "__lm_h") \
                  .rowsBetween(Window.unboundedPreceding, -1)
    j = placed.join(offs, placed[source_col].eqNullSafe(offs["__lm_s"]) & (placed["__lm_b"] == offs["__lm_bb"])) \
              .withColumn("__lm_at", F.col("__lm_base") + F.coalesce(F.sum("__lm_size").over(inner), F.lit(0)))
    j = j.join(F.broadcast(side), j[source_col].eqNullSafe(side["__lm_src"]))     # MAX_SOURCES rows at most
    size = F.col("__lm_size")
    part = F.least(F.greatest(F.col("__lm_rest") - F.col("__lm_at"), F.lit(0)), size)     # of the epoch that is not whole
    near = F.least(part, size - part) <= F.col("__lm_target") * SLACK
    part = F.when(near, F.when(2 * part < size, 0).otherwise(size)).otherwise(part).cast("long")
    j = j.withColumn("__lm_part", part)
    copies = F.when(size > 0, F.col("__lm_epochs")).otherwise(0) + (F.col("__lm_part") > 0).cast("long")
    last = F.element_at("__lm_upto", -1) - 1             # words left over go with the last block

    def shard(copy):
        block = F.least(F.floor((copy * F.col("__lm_total") + F.col("__lm_at")) / BLOCK), last)
        return F.when(last < 0, F.col("__lm_spare")).otherwise(F.size(F.filter("__lm_upto", lambda u: u <= block)))

    shards = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), shard)).otherwise(F.array().cast("array<int>"))
    return j.select(*[rows[c] for c in names], "__lm_total", "__lm_target", "__lm_epochs", "__lm_part", shards.alias("__lm_shards"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, max_repeat: int = MAX_REPEAT, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, ``source``, ``size`` (words), ``source_size``,
    ``target`` (words of its source in the mix), ``taken`` (words the mix
    takes of it, repeats counted; ``max_repeat`` times its size at most) and
    ``shards`` (the shard of each copy, joined by commas; empty if none is taken).

    Weights go round the sources by code point, null last.  Null and empty
    texts have size 0 and take 0.  Null ids and repeated rows are rows like
    others.  An empty table, or one without words, takes nothing.  The result
    depends on ids, texts, sources and the seed only.
    """
    rows = checkpointed(_sized(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                         F.col(text_col).alias("text")), "text")
                        .select("id", "source", "__lm_size", text_hash(F.col("text")).alias("__lm_h")))
    j = _place(rows, "id", "source", weights, max_repeat, n_shards, seed)
    return j.select(F.col("id").alias(id_col), "source", F.col("__lm_size").alias("size"), F.col("__lm_total").alias("source_size"),
                    F.col("__lm_target").alias("target"),
                    (F.col("__lm_epochs") * F.col("__lm_size") + F.col("__lm_part")).alias("taken"),
                    F.concat_ws(",", "__lm_shards").alias("shards"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: bytes, n: int, size: int) -> bytes:
    """The first ``n`` of the ``size`` words of ``text``; the text itself if that is all."""
    if n >= size:
        return text
    found = list(islice(_WORD.finditer(text), n))
    return text[found[0].start():found[-1].end()]


def _copy_batches(text_col: str, chars_col: str | None, shard_col: str | None):
    def run(batches):
        for b in slices(batches, text_col):
            row, out, shards = [], [], []
            epochs = b.column("__lm_epochs").to_pylist()
            parts = b.column("__lm_part").to_pylist()
            sizes = b.column("__lm_size").to_pylist()
            dealt = b.column("__lm_shards").to_pylist()
            for i, t in enumerate(texts(b.column(text_col))):
                n = epochs[i] if sizes[i] else 0
                row += [i] * n
                out += [t] * n
                shards += dealt[i]
                if parts[i]:
                    row.append(i)
                    out.append(cut_words(t, parts[i], sizes[i]))
            if not row:
                continue
            at = pa.array(row)
            cols = {c: b.column(c).take(at) for c in b.schema.names if not c.startswith("__lm_")}
            cols[text_col] = pa.array(out, pa.binary()).cast(pa.string())
            if chars_col in cols:
                cols[chars_col] = pa.array([len(x.decode()) for x in out]).cast(cols[chars_col].type)
            if shard_col:
                cols[shard_col] = pa.array(shards, pa.int32())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
    return run


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    chars_col: str | None = "n_chars", weights=WEIGHTS, max_repeat: int = MAX_REPEAT,
                    n_shards: int = N_SHARDS, seed: int = SEED, shard_col: str | None = None) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for each copy the mix
    takes of a document, with the text it takes (whole, or for one document a
    source at most its first words) and ``chars_col`` set anew; ``shard_col``
    names a further column for the copy's shard (a column of that name goes).
    Documents without words, null and empty texts among them, are not in a mix;
    an empty table gives none.  Nulls, ties, repeated rows and columns of other
    names are as in ``mix_sources``."""
    df = without(df, shard_col) if shard_col else df
    rows = _sized(df, text_col).withColumn("__lm_h", text_hash(F.col(text_col)))
    j = _place(rows, id_col, source_col, weights, max_repeat, n_shards, seed)
    return j.select(*[rows[c] for c in df.columns], "__lm_size", "__lm_epochs", "__lm_part", "__lm_shards") \
            .mapInArrow(_copy_batches(text_col, chars_col, shard_col), extended(df.schema, **{shard_col: T.IntegerType()}) if shard_col else df.schema)
