"""Probability-array helpers (E1, E7, M10, M11, M13) on array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col

EPS = 1e-15


def argmax(probability) -> Column:
    """0-based index of the first maximum."""
    a = col(probability)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_prob(probability) -> Column:
    return F.array_max(col(probability))


def certainty(probability) -> Column:
    """min(1, 2 * (p1 - p2)) over the two largest probabilities."""
    s = F.sort_array(col(probability), asc=False)
    return F.least(F.lit(1.0), (s[0] - s[1]) * 2)


def log_probs(probability, eps: float = EPS) -> Column:
    """log(clip(p, eps, 1 - eps)) element-wise ("logits" of the reference)."""
    return F.transform(col(probability),
                       lambda p: F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))))


def softmax(logits, temperature=None) -> Column:
    """Stable row softmax, optionally of logits / T."""
    z = col(logits)
    if temperature is not None:
        t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
        z = F.transform(z, lambda x: x / t)
    m = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def rule_probabilities(grade_sum: Column, sharpness: float = 2.0, n_classes: int = 4) -> Column:
    """Stand-in model for testing the scoring chain with value oracles:
    w = grade_sum / 3, p_k proportional to exp(-sharpness * |w - k|)."""
    w = grade_sum / 3.0
    e = F.array(*[F.exp(-sharpness * F.abs(w - k)) for k in range(n_classes)])
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def one_hot(label, width) -> Column:
    w = width if isinstance(width, Column) else F.lit(int(width))
    lab = col(label)
    return F.transform(F.sequence(F.lit(0), w - 1), lambda i: F.when(lab == i, 1.0).otherwise(0.0))
