"""Water-quality indices and the rule classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col


def wqi_simple(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """Simple WQI: normalised pH / TDS / turbidity, weights .4 / .3 / .3."""
    t, u, p = col(tds), col(turbidity), col(ph)
    ph_n = F.greatest(F.lit(0.0), 100.0 - F.abs(p - 7.0) * 20)
    tds_n = F.greatest(F.lit(0.0), 100.0 - t / 10)
    tu_n = F.greatest(F.lit(0.0), 100.0 - u * 10)
    w = (ph_n * 0.4 + tds_n * 0.3 + tu_n * 0.3) / 1.0
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), w))


def wqi_service(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """The service's WQI (different sub-indices from the simple one)."""
    t, u, p = col(tds), col(turbidity), col(ph)
    d = F.abs(p - 7.25)
    ph_i = (F.when(p.between(7.0, 7.5), F.lit(100.0))
            .when(p.between(6.5, 8.5), 80.0 - d * 20)
            .when(p.between(6.0, 9.0), 60.0 - d * 10)
            .otherwise(F.greatest(F.lit(0.0), 40.0 - d * 10)))
    tds_i = (F.when(t <= 300, F.lit(100.0))
             .when(t <= 600, 100.0 - (t - 300) / 3)
             .when(t <= 900, 60.0 - (t - 600) / 7.5)
             .otherwise(F.greatest(F.lit(0.0), 20.0 - (t - 900) / 50)))
    tu_i = (F.when(u <= 1, F.lit(100.0))
            .when(u <= 4, 100.0 - (u - 1) * 10)
            .when(u <= 10, 60.0 - (u - 4) * 5)
            .otherwise(F.greatest(F.lit(0.0), 30.0 - (u - 10) * 3)))
    w = ph_i * 0.4 + tds_i * 0.3 + tu_i * 0.3
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), w))


# Assessment texts.
ASSESS_SAFE = "Safe for consumption with excellent/good quality indicators"
ASSESS_GENERAL = "Generally safe for consumption with regular monitoring recommended"
ASSESS_TREAT = "Treatment or filtration recommended before consumption"


def overall_assessment(quality_class, wqi) -> Column:
    c, w = col(quality_class), col(wqi)
    return (F.when((c >= 2) & (w >= 70), F.lit(ASSESS_SAFE))
            .when((c >= 1) & (w >= 50), F.lit(ASSESS_GENERAL))
            .otherwise(F.lit(ASSESS_TREAT)))


def demo_score(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """Demo point score: pH 40/30/20/10 + TDS 35/25/15/5 + turbidity 25/20/10/5."""
    t, u, p = col(tds), col(turbidity), col(ph)
    s_ph = (F.when(p.between(7.0, 7.5), 40).when(p.between(6.5, 8.5), 30)
            .when(p.between(6.0, 9.0), 20).otherwise(10))
    s_t = F.when(t <= 300, 35).when(t <= 600, 25).when(t <= 900, 15).otherwise(5)
    s_u = F.when(u <= 1, 25).when(u <= 4, 20).when(u <= 10, 10).otherwise(5)
    return (s_ph + s_t + s_u).cast("int")


def demo_class(score) -> Column:
    s = col(score)
    return F.when(s >= 80, 3).when(s >= 65, 2).when(s >= 45, 1).otherwise(0).cast("int")


def demo_confidence(score) -> Column:
    s = col(score)
    return (F.when(s >= 80, 0.9).when(s >= 65, 0.8).when(s >= 45, 0.7)
            .otherwise(0.6))
