"""SMOTE oversampling (M9) with exact within-class k-nearest neighbours
(J2) and the union of original and synthetic rows (J6).

Neighbours are Euclidean on the raw sensors, ties by id, found on a k-d
partition (``knn``).  Rows with a NULL, NaN or infinite sensor have no
neighbours and are nobody's neighbour.

Synthesis is deterministic: every class below the majority size gets
``need = n_max - n_c`` new rows; each base row makes ``need // n_c`` copies,
the first ``need % n_c`` rows in seeded-hash order one more (cut found by
order statistics, not a class-wide sort); copy ``j`` of base ``b`` takes
neighbour rank 1 + h1(b, j) mod k_b and lambda = (h2(b, j) mod 1000) / 1000,
x_new = x + lambda (nn - x).

Counts, points, order statistics and the joins read the rows many times,
most filter them by class; the rows are made once and kept (``kept_rows``), else
each reading would be parsed and classed again in every pass.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.samples import HASH_MOD, row_hash
from .knn import neighbor_lists
from .ml import kth_keys

FEATURES = ["tds", "turbidity", "ph"]


def kept_rows(df: DataFrame, label: str = "quality", key: str = "reading_id",
              feats: Sequence[str] = FEATURES) -> DataFrame:
    """Key, class and sensors of ``df``, made once and written to the shared
    folder, where every pass reads them (and only the columns it needs)."""
    path = scratch_path(df.sparkSession, "smote")
    rows = df.select(key, label, *feats)
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _with_neighbors(rows: DataFrame, lists: DataFrame, k: int, label: str, key: str,
                    feats: Sequence[str]) -> DataFrame:
    """``rows`` with their own k neighbours as the array ``_nn`` (NULL where
    a row has no point)."""
    theirs = lists.select(F.col("_c").alias(label), *feats, F.col("_nn").alias("_all"))
    on = [label, *feats]
    out = rows.withColumns({f: F.col(f).cast("double") for f in feats}).join(theirs, on, "left")
    return out.withColumn("_nn", F.slice(F.filter("_all", lambda x: x["id"] != F.col(key)), 1, k)).drop("_all")


def nearest_neighbors(df: DataFrame, k: int = 5, label: str = "quality", key: str = "reading_id",
                      feats: Sequence[str] = FEATURES, classes=None, kept: bool = False) -> DataFrame:
    """Exact k nearest neighbours within each class.

    Returns (pid, label, rank 1..k, nid, d2, neighbour features) with
    ``nid`` != ``pid``; classes with fewer than k + 1 rows return all
    their other rows.  ``kept``: ``df`` comes from ``kept_rows``."""
    df = df if kept else kept_rows(df, label, key, feats)
    lists = neighbor_lists(df, k, label, key, feats, classes)
    rows = df.select(key, label, *feats)
    if classes is not None:
        rows = rows.where(F.col(label).isin(list(classes)))
    near = _with_neighbors(rows, lists, k, label, key, feats)
    return (near.select(F.col(key).alias("pid"), label, F.posexplode("_nn").alias("_i", "_x"))
            .select("pid", label, (F.col("_i") + 1).alias("rank"), F.col("_x.id").alias("nid"),
                    F.col("_x.d2").alias("d2"), *[F.col(f"_x.{f}").alias(f"nn_{f}") for f in feats]))


def smote(df: DataFrame, k: int = 5, label: str = "quality", key: str = "reading_id",
          feats: Sequence[str] = FEATURES, seed: int = 42, kept: bool = False) -> DataFrame:
    """M9: raise every class to the majority size with synthetic rows;
    returns originals (``copy = -1``) and synthetics, with ``source_id`` the
    base row (J6 union).  ``kept``: ``df`` comes from ``kept_rows``."""
    df = df if kept else kept_rows(df, label, key, feats)
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n_max = max(counts.values())
    plan = {c: (n_max - n, (n_max - n) // n, (n_max - n) % n) for c, n in counts.items()}
    minority = [c for c, (need, _, _) in plan.items() if need > 0]
    originals = df.select(F.col(key).alias("source_id"), F.lit(-1).alias("copy"),
                          F.col(label).alias(label), *feats)
    if not minority:
        return originals
    lists = neighbor_lists(df, k, label, key, feats, classes=minority)
    base = df.where(F.col(label).isin(minority)).withColumn("_h", row_hash(key, seed))
    ranks = {c: (c, plan[c][2] - 1) for c in minority if plan[c][2] > 0}
    cut = kth_keys(base, label, key, "_h", ranks) if ranks else {}
    spark = df.sparkSession
    lab_type = dict(df.dtypes)[label]
    pl = spark.createDataFrame(
        [(c, plan[c][1], *(cut.get(c, (-1, -1)))) for c in minority],
        f"{label} {lab_type}, _q long, _cut_h long, _cut_k long")
    extra = ((F.col("_h") < F.col("_cut_h"))
             | ((F.col("_h") == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_k"))))
    chosen_rows = (base.join(F.broadcast(pl), label)
                   .withColumn("_m", F.col("_q") + extra.cast("long")).where(F.col("_m") > 0))
    syn = (_with_neighbors(chosen_rows, lists, k, label, key, feats)
           .select(F.col(key).alias("source_id"), label, *feats, "_nn", "_h",
                   F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("copy")))
    kb = F.greatest(F.coalesce(F.size("_nn"), F.lit(0)), F.lit(0))
    # both draws come from the seeded hash of the whole id, and the copy
    high, low = F.call_function("div", F.col("_h"), F.lit(2147483648).cast("long")), F.pmod("_h", F.lit(2147483648).cast("long"))
    pick = F.pmod(F.pmod(high * 48271 + F.col("copy") * 7919, F.lit(HASH_MOD)), F.greatest(kb, F.lit(1)))
    lam = F.pmod(F.pmod(low * 16807 + F.col("copy") * 104729, F.lit(HASH_MOD)), F.lit(1000)) / 1000.0
    chosen = F.col("_nn")[pick.cast("int")]
    new_vals = [F.when(kb > 0, F.col(f) + lam * (chosen[f] - F.col(f))).otherwise(F.col(f)).alias(f)
                for f in feats]
    synthetic = syn.select("source_id", F.col("copy").cast("int").alias("copy"), label, *new_vals)
    return originals.unionByName(synthetic)
