"""Evaluation metrics (A13-A16, M22, M24): confusion matrix, accuracy,
classification report, per-class accuracy.  All are conditional counts in
one aggregation over (actual, predicted); the 4 x 4 result is tiny."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLASSES = (0, 1, 2, 3)
#: Most distinct (actual, predicted) pairs that come to the driver.
MAX_PAIRS = 1_000_000


def _confusion(df: DataFrame, actual: str, predicted: str, classes: Sequence[int]) -> tuple[dict, list]:
    """Counts by (actual, predicted) and the classes: those given and any
    others that occur.  Raises on a NULL class and beyond ``MAX_PAIRS``."""
    counts = (df.groupBy(F.col(actual).cast("int").alias("actual"),
                         F.col(predicted).cast("int").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")).limit(MAX_PAIRS + 1).collect())
    if len(counts) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of classes: {actual} or {predicted} is no class")
    seen = {(r["actual"], r["predicted"]): r["n"] for r in counts}
    found = {c for pair in seen for c in pair}
    if None in found:
        raise ValueError(f"{actual} or {predicted} holds NULL")
    return seen, sorted(set(classes) | found)


def confusion_counts(df: DataFrame, actual: str, predicted: str,
                     classes: Sequence[int] = CLASSES) -> DataFrame:
    """(actual, predicted, n) for every pair of classes, zeros included."""
    # a metric table of at most classes^2 rows: every metric branch reads
    # it instead of recomputing the scored input
    seen, full = _confusion(df, actual, predicted, classes)
    return df.sparkSession.createDataFrame([(a, p, int(seen.get((a, p), 0))) for a in full for p in full],
                                           "actual int, predicted int, n long")


def confusion_matrix(df: DataFrame, actual: str, predicted: str,
                     classes: Sequence[int] = CLASSES) -> DataFrame:
    """Actual x predicted, one column per predicted class; a class that
    occurs beside ``classes`` gets its row and column too."""
    seen, full = _confusion(df, actual, predicted, classes)
    return df.sparkSession.createDataFrame([(a, *[int(seen.get((a, p), 0)) for p in full]) for a in full],
                                           ", ".join(["actual int", *[f"pred_{p} long" for p in full]]))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """A14."""
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, actual: str, predicted: str,
                          classes: Sequence[int] = CLASSES) -> DataFrame:
    """Precision / recall / F1 / support per class, macro and weighted
    averages; 0 where a ratio has a zero denominator (sklearn's
    zero_division=0).  Classes absent from both columns are left out."""
    cc = confusion_counts(df, actual, predicted, classes)
    per = (cc.groupBy(F.col("actual").alias("cls")).agg(
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support")))
    pred_tot = cc.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("pred_n"))
    m = per.join(pred_tot, "cls")
    m = m.where((F.col("support") > 0) | (F.col("pred_n") > 0))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    m = m.select(F.col("cls").cast("string").alias("label"), prec.alias("precision"),
                 rec.alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    m = m.withColumn("f1", f1)
    # per-class frame has <= 4 rows: the global windows below are tiny
    w = Window.partitionBy()
    tot = F.sum("support").over(w)
    avgs = m.select(
        F.avg("precision").over(w).alias("macro_p"), F.avg("recall").over(w).alias("macro_r"),
        F.avg("f1").over(w).alias("macro_f"),
        (F.sum(F.col("precision") * F.col("support")).over(w) / tot).alias("w_p"),
        (F.sum(F.col("recall") * F.col("support")).over(w) / tot).alias("w_r"),
        (F.sum(F.col("f1") * F.col("support")).over(w) / tot).alias("w_f"),
        tot.alias("tot")).limit(1)
    macro = avgs.select(F.lit("macro avg").alias("label"), F.col("macro_p").alias("precision"),
                        F.col("macro_r").alias("recall"), F.col("tot").alias("support"),
                        F.col("macro_f").alias("f1"))
    weighted = avgs.select(F.lit("weighted avg").alias("label"), F.col("w_p").alias("precision"),
                           F.col("w_r").alias("recall"), F.col("tot").alias("support"),
                           F.col("w_f").alias("f1"))
    return m.unionByName(macro).unionByName(weighted)


def per_class_accuracy(df: DataFrame, actual: str, predicted: str,
                       classes: Sequence[int] = CLASSES) -> DataFrame:
    """cm[i, i] / row sum, 0 for an empty row."""
    cc = confusion_counts(df, actual, predicted, classes)
    return cc.groupBy("actual").agg(
        F.coalesce(F.try_divide(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                                      .otherwise(0)).cast("double"), F.sum("n")),
                   F.lit(0.0)).alias("accuracy"),
        F.sum("n").alias("support"))


def summary(df: DataFrame, actual: str, predicted: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """One row per class (label, accuracy, support) and one labelled
    ``all``: overall accuracy and the number of rows."""
    seen, full = _confusion(df, actual, predicted, classes)
    support = {a: sum(seen.get((a, p), 0) for p in full) for a in full}
    right = {a: seen.get((a, a), 0) for a in full}
    rows = [(str(a), right[a] / support[a] if support[a] else 0.0, support[a]) for a in full]
    n = sum(support.values())
    rows.append(("all", sum(right.values()) / n if n else 0.0, n))
    return df.sparkSession.createDataFrame(rows, "label string, accuracy double, support long")
