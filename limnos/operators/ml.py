"""ML data operators: exact stratified split, population-std scaler,
one-hot target, balanced class weights, preprocessing (M1-M5, M25, W1).

Only per-class counts, per-class rank thresholds and per-feature moments
reach the driver; each is bounded by the class or feature count.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Dict, List, Sequence, Tuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import one_hot as one_hot_col
from ..sources.samples import row_hash
from .order_stats import order_statistics


def _split_counts(n: int, test: float, val: float) -> Tuple[int, int]:
    """Exact per-class test / validation sizes: round(n * test), then
    round(rest * val / (1 - test)) — the stratified two-step split."""
    n_test = int(n * test + 0.5)
    rest = n - n_test
    n_val = int(rest * (val / (1 - test)) + 0.5) if val else 0
    return n_test, n_val


def kth_keys(df: DataFrame, label: str, key: str, order: str,
             ranks: Dict[Tuple[object, str], Tuple[object, int]]) -> Dict[Tuple[object, str], Tuple[int, int]]:
    """Exact k-th smallest composite key (order, key) per class: the order
    value by bounded order statistics, then the key among rows tied on it.
    The tie bookkeeping for all targets is one aggregation; only targets
    with several tied rows need another order-statistics pass."""
    first = order_statistics(df, order, ranks, group=label)
    tids = list(ranks)
    aggs = []
    for i, t in enumerate(tids):
        g, v = ranks[t][0], first[t]
        in_g = F.col(label) == F.lit(g)
        tie = in_g & (F.col(order) == F.lit(v))
        aggs += [F.count_if(in_g & (F.col(order) < F.lit(v))).alias(f"b{i}"),
                 F.count_if(tie).alias(f"n{i}"), F.min(F.when(tie, F.col(key))).alias(f"k{i}")]
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, t in enumerate(tids):
        g, rank = ranks[t]
        v, below, n_tie = first[t], row[f"b{i}"], row[f"n{i}"]
        if n_tie == 1 or rank - below == 0:
            out[t] = (v, int(row[f"k{i}"]))
        else:
            ties = df.where((F.col(label) == g) & (F.col(order) == v))
            out[t] = (v, int(order_statistics(ties, key, {0: (None, rank - below)})[0]))
    return out


def stratified_split(df: DataFrame, label: str = "quality", key: str = "reading_id",
                     test: float = 0.2, val: float = 0.2, seed: int = 42,
                     name: str = "split") -> DataFrame:
    """M1: exact stratified train / val / test split.

    Rows of each class are ordered by a seeded hash of the key (ties by the
    key); the first round(n_c * test) go to ``test``, the next
    round(rest * val / (1 - test)) to ``val``, the rest to ``train``.  Class
    counts are exact (not Bernoulli like ``randomSplit``), the result is
    stable under repartitioning, and no class is ever sorted in one task:
    the two cut points per class come from ``order_statistics``.  A ``test``
    of 0 or None means the default; a ``val`` of None means the default and
    0 means no validation rows.
    """
    test = test or 0.2
    val = val if val is not None else 0.2
    h = df.withColumn("_h", row_hash(key, seed))
    # the bisection passes read only (label, key, hash): keep that narrow
    # projection for them (lost blocks recompute from lineage), then drop it
    narrow = h.select(label, key, "_h").persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r[0]: r[1] for r in narrow.groupBy(label).count().collect()}
    ranks, cuts = {}, {}
    for g, n in counts.items():
        n_test, n_val = _split_counts(n, test, val)
        cuts[g] = (n_test, n_val)
        if n_test > 0:
            ranks[(g, "test")] = (g, n_test - 1)
        if n_val > 0:
            ranks[(g, "val")] = (g, n_test + n_val - 1)
    try:
        keys = kth_keys(narrow, label, key, "_h", ranks) if ranks else {}
    finally:
        narrow.unpersist()
    rows = [(g, *keys.get((g, "test"), (-1, -1)), *keys.get((g, "val"), (-1, -1)))
            for g in counts]
    # one row per class: bounded, broadcast
    th = df.sparkSession.createDataFrame(
        rows, f"{label} {dict(df.dtypes)[label]}, _t_h long, _t_k long, _v_h long, _v_k long")

    def le(hc: Column, kc: Column) -> Column:
        return (F.col("_h") < hc) | ((F.col("_h") == hc) & (F.col(key) <= kc))

    out = h.join(F.broadcast(th), label)
    return (out.withColumn(name, F.when(le(F.col("_t_h"), F.col("_t_k")), "test")
                           .when(le(F.col("_v_h"), F.col("_v_k")), "val").otherwise("train"))
            .drop("_h", "_t_h", "_t_k", "_v_h", "_v_k"))


@dataclass
class PopulationScaler:
    """M2: standard scaling with the *population* std (ddof 0), fitted on
    the training rows only; a zero-variance column is scaled by 1.
    (``pyspark.ml.feature.StandardScaler`` uses the sample std.)"""

    columns: List[str]
    means: Dict[str, float] = None
    stds: Dict[str, float] = None

    def fit(self, df: DataFrame) -> "PopulationScaler":
        aggs = [f for c in self.columns
                for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
        row = df.agg(*aggs).collect()[0]
        self.means = {c: row[f"m_{c}"] for c in self.columns}
        self.stds = {c: (row[f"s_{c}"] or 0.0) for c in self.columns}
        return self

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        cols = []
        for c in df.columns:
            if c in self.columns:
                s = self.stds[c] if self.stds[c] != 0 else 1.0
                cols.append(((F.col(c) - F.lit(self.means[c])) / F.lit(s)).alias(c + suffix))
                if suffix:
                    cols.append(F.col(c))
            else:
                cols.append(F.col(c))
        return df.select(*cols)

    def params(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, self.means[c], self.stds[c]) for c in self.columns],
                                     "feature string, mean double, std double")


MAX_CLASSES = 10_000   # most label values: bounds what is collected and broadcast by class


def fit_moments(df: DataFrame, columns: Sequence[str], label: str) -> Tuple[PopulationScaler, Dict[object, int]]:
    """The scaler over all rows and the number of rows of each class, from one
    scan: counts, means and variances by class, put together on the driver
    (one row a class; more than ``MAX_CLASSES`` label values raise)."""
    aggs = [f for i, c in enumerate(columns) for f in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"))]
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *aggs).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"over {MAX_CLASSES} values: is {label} a class?")
    scaler = PopulationScaler(list(columns), {}, {})
    for i, c in enumerate(columns):
        own = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in rows if r[f"n{i}"]]
        n = sum(k for k, _, _ in own)
        mean = sum(k * m for k, m, _ in own) / n if n else 0.0
        scaler.means[c] = mean
        scaler.stds[c] = (sum(k * (v + (m - mean) ** 2) for k, m, v in own) / n) ** 0.5 if n else 0.0
    return scaler, {r[label]: r["n"] for r in rows if r[label] is not None}


def one_hot(df: DataFrame, label: str = "quality", prefix: str = "y") -> DataFrame:
    """M3: one-hot target, width = max label + 1 (like ``to_categorical``)."""
    width = df.agg(F.max(label)).collect()[0][0] + 1
    arr = one_hot_col(label, width)
    return df.select("*", *[arr[i].alias(f"{prefix}_{i}") for i in range(width)])


def class_weights(df: DataFrame, label: str = "quality") -> DataFrame:
    """M4: balanced weights n / (k * n_c), keyed by the class *value*
    (quirk Q-8 fixed).  One row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    # the aggregated frame has one row per class: a global window is tiny
    everything = Window.partitionBy()
    return counts.select(label, (F.sum("n_c").over(everything)
                                 / (F.count(F.lit(1)).over(everything) * F.col("n_c")))
                         .alias("weight"))


def preprocess(df: DataFrame, features: Sequence[str], label: str = "quality",
               key: str = "reading_id", seed: int = 42):
    """M5: split -> scaler and class weights from one scan of train, weights
    joined by class.
    Returns (frame with ``split``, scaled features and ``weight``, scaler,
    weights frame)."""
    split = stratified_split(df, label, key, seed=seed)
    scaler, counts = fit_moments(split.where(F.col("split") == "train"), features, label)
    n = sum(counts.values())
    weights = df.sparkSession.createDataFrame([(c, n / (len(counts) * k)) for c, k in counts.items()],
                                              f"{label} {dict(df.dtypes)[label]}, weight double")
    out = scaler.transform(split).join(F.broadcast(weights), label, "left")
    return out, scaler, weights
