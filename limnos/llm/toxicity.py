"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram (orders 4 to 6, lower case) that a text holds, or
holds densely: twice and once in ``DENSE`` characters or more, so that a rude
word stem tells apart a text that is full of it from a long one that has it by
chance.  Ratios come from the numbers of labelled texts of each class that show
a feature; the ``FEATURES`` features whose shares differ most (in standard
errors) enter a logistic regression on the scaled features, fitted by L-BFGS on
a bounded sample of labelled texts, each class weighted by its true number.
Scoring looks the n-grams of every whole text up in one table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import first_by_hash, shared_path, slices

BITS = 18
BUCKETS = 1 << BITS
ORDERS = (4, 5, 6)
DENSE = 1000
FEATURES = 4096
MAX_FIT = 20_000       # most labelled texts of each class that the model is fitted on
SMOOTH = 1.0
RIDGE = 1.0
THRESHOLD = 0.3
SEED = 42
_MIX = np.uint32(0x9E3779B1)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of a code point array, repeats included."""
    out, h = [], np.zeros(len(chars), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(chars) - n + 1
        if m < 1:
            break
        h = (h[:m] ^ chars[n - 1:]) * _MIX
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            out.append((h + np.uint32(n)) * _MIX >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def dense(times: np.ndarray, n_chars: int) -> np.ndarray:
    return (times >= 2) & (times * DENSE >= n_chars)


def features(text: str | None) -> np.ndarray:
    """Distinct features: a held bucket, or BUCKETS + a densely held one."""
    chars = code_points(text)
    held, times = np.unique(grams(chars), return_counts=True)
    held = held.astype(np.int64)
    return np.concatenate((held, held[dense(times, len(chars))] + BUCKETS))


class Model:
    """Weights of chosen buckets, when held and when densely held, and an
    offset.  ``slot`` leads from a bucket to its weights (0: not chosen)."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, offset: float):
        buckets = np.unique(chosen % BUCKETS)
        self.slot = np.zeros(BUCKETS, dtype=np.int32)
        self.slot[buckets] = np.arange(1, len(buckets) + 1)
        self.by_slot = np.zeros((2, len(buckets) + 1))
        np.add.at(self.by_slot, (chosen // BUCKETS, self.slot[chosen % BUCKETS]), weights)
        self.offset = float(offset)

    def plain(self) -> tuple:
        return self.slot, self.by_slot, self.offset

    @classmethod
    def of(cls, plain: tuple) -> Model:
        self = cls.__new__(cls)
        self.slot, self.by_slot, self.offset = plain
        return self

    def score(self, text: str | None) -> float:
        chars = code_points(text)
        at = self.slot[grams(chars)]
        times = np.bincount(at[at > 0], minlength=self.by_slot.shape[1])
        z = self.offset + self.by_slot[0, times > 0].sum() + self.by_slot[1, dense(times, len(chars))].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_ratios(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of each feature, from the number of texts of
    each class that show it (2 x features) and that there are."""
    share = (counts + SMOOTH) / (n[:, None] + 2 * SMOOTH)
    return np.log(share[1]) - np.log(share[0])


def telling(counts: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The k features whose class shares differ by most standard errors (equal
    ones by number), in order; features without a difference never."""
    share = (counts + SMOOTH) / (n[:, None] + 2 * SMOOTH)
    error = np.sqrt((share * (1 - share) / (n[:, None] + 2 * SMOOTH)).sum(axis=0))
    far = np.where(counts.sum(axis=0) > 0, np.abs(share[1] - share[0]) / error, 0.0)
    best = np.argsort(-far, kind="stable")[:k]
    return np.sort(best[far[best] > 0])


def fit_linear(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE,
               steps: int = 100, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with offset on binary features (row, col)
    scaled by ``scale``, by L-BFGS: (weights of the unscaled features, offset)."""
    n, k = len(y), len(scale)

    def loss(v):
        z = np.bincount(row, weights=(v[:-1] * scale)[col], minlength=n) + v[-1]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        gradient = np.append(np.bincount(col, weights=e[row], minlength=k) * scale + ridge * v[:-1], e.sum())
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (v[:-1] @ v[:-1]), gradient

    share = (weight @ y) / weight.sum()
    v = np.append(np.zeros(k), np.log(share / (1 - share)))
    now, g = loss(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = g.copy(), []
        for s, u in reversed(past):
            alphas.append((s @ d) / (u @ s))
            d -= alphas[-1] * u
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, u), a in zip(past, reversed(alphas)):
            d += s * (a - (u @ d) / (u @ s))
        size = 1.0
        while True:
            after, g2 = loss(v - size * d)
            if after <= now - 1e-4 * size * (g @ d) or size < 1e-10:
                break
            size /= 2
        s, u = -size * d, g2 - g
        if after > now or s @ u <= 0:
            break
        past = [*past, (s, u)][-8:]
        v, last, now, g = v + s, now, after, g2
        if last - now <= tolerance * abs(last):
            break
    return v[:-1] * scale, float(v[-1])


def held_out(id_col: Column) -> Column:
    """The rows kept out of training: crc32 of the id as text has remainder 2
    by 4 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count_batches(batches):
    """Per partition: texts of each class that show a feature."""
    counts = np.zeros((2, 2 * BUCKETS), dtype=np.int64)
    for b in slices(batches, "_text"):
        for t, y in zip(b.column("_text").to_pylist(), b.column("_y").to_pylist()):
            counts[y, features(t)] += 1
    for y in (0, 1):
        at = np.flatnonzero(counts[y])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y, dtype=np.int32)), pa.array(at), pa.array(counts[y, at])],
                                         ["y", "feature", "n"])


def _row_batches(chosen: np.ndarray):
    """Positions in ``chosen`` of the features of each text."""
    def run(batches):
        place = np.full(2 * BUCKETS, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        for b in slices(batches, "_text"):
            got = [place[features(t)] for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array([p[p >= 0].astype(np.int16).tobytes() for p in got], pa.binary())],
                                             ["y", "at"])
    return run


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_fit: int = MAX_FIT, n_features: int = FEATURES, seed: int = SEED) -> Model:
    """The model from the rows of ``df`` that ``labels`` marks, at most
    ``max_fit`` of a class (those of the smallest seeded hashes of the id).  Of
    labels of one id that disagree, 1 counts.  Without both classes the model
    has no features and scores 0, or 1 if there is only label 1."""
    spark = df.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
                  .groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) >= 1).cast("int")).alias("_y"))
    order = F.xxhash64(F.lit(seed), "_id")
    sample = first_by_hash(known.filter(F.col("_y") == 0), order, max_fit, "_id") \
        .union(first_by_hash(known.filter(F.col("_y") == 1), order, max_fit, "_id"))        # bounded, so it may be broadcast
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_y")
    path = shared_path(spark, "toxicity")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    total = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    have = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if len(have) < 2:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 500.0 if 1 in have else -500.0)
    n = np.array([have[0], have[1]], dtype=float)
    counts = np.zeros((2, 2 * BUCKETS))
    packed = rows.mapInArrow(_count_batches, "y int, feature long, n long").groupBy("y", "feature").agg(F.sum("n").alias("n"))
    for b in packed.toArrow().to_batches():                                         # at most 4 * BUCKETS rows
        counts[b.column("y").to_numpy(), b.column("feature").to_numpy()] = b.column("n").to_numpy()
    chosen = telling(counts, n, min(n_features, 1 << 15))
    ratio = log_ratios(counts, n)[chosen]
    got = rows.mapInArrow(_row_batches(chosen), "y int, at binary").collect()       # at most 2 * max_fit rows
    at = [np.frombuffer(r["at"], dtype=np.int16).astype(np.int64) for r in got]
    y = np.array([r["y"] for r in got], dtype=float)
    weight = np.where(y > 0, total[1] / n[1], total[0] / n[0])
    weights, offset = fit_linear(np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at), ratio, y,
                                 weight * len(y) / weight.sum())
    return Model(chosen, weights, offset)


def _score_batches(held):
    def run(batches):
        model = Model.of(held.value)
        for b in slices(batches, "_text"):
            score = [model.score(t) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("held_out"), pa.array(score, pa.float64())],
                                             ["_id", "held_out", "score"])
    return run


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   threshold: float = THRESHOLD, max_fit: int = MAX_FIT, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, ``held_out``, ``score`` and ``predicted``
    (1 if the score reaches the threshold).

    Learns from labelled rows that are not held out; a score reads the text
    only.  Null and empty texts have no features and score by the offset, as
    does every text where ``train`` found one class or none.  Null ids are
    scored and never matched to a label; repeated rows each give a row, and each
    counts where labelled; an empty table gives none; other columns are not read.
    """
    own = ~held_out(F.col(id_col))
    model = train(df.filter(own), labels.filter(own), id_col, text_col, label_col, max_fit, seed=seed)
    held = df.sparkSession.sparkContext.broadcast(model.plain())
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text")) \
            .mapInArrow(_score_batches(held), f"_id {kind}, held_out boolean, score double")
    return out.select(F.col("_id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
