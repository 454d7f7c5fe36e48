"""Per-parameter grades and the labelling rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col


def ph_grade(ph="ph") -> Column:
    """0-3 pH grade: 3 in [7, 7.5], 2 in [6.5, 8.5], 1 in [6, 9], else 0."""
    p = col(ph)
    return (F.when(p.between(7.0, 7.5), 3).when(p.between(6.5, 8.5), 2)
            .when(p.between(6.0, 9.0), 1).otherwise(0))


def tds_grade(tds="tds") -> Column:
    """0-3 TDS grade: <=300 / <=600 / <=900 -> 3 / 2 / 1, else 0."""
    t = col(tds)
    return F.when(t <= 300, 3).when(t <= 600, 2).when(t <= 900, 1).otherwise(0)


def turbidity_grade(turbidity="turbidity") -> Column:
    """0-3 turbidity grade: <=1 / <=4 / <=10 -> 3 / 2 / 1, else 0."""
    u = col(turbidity)
    return F.when(u <= 1, 3).when(u <= 4, 2).when(u <= 10, 1).otherwise(0)


def quality_class(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """Weighted class: s = .4 pH + .3 TDS + .3 turbidity grade, cut at
    2.5 / 1.5 / .5.  Evaluated in integers (10 s) so no float tie can flip."""
    s10 = 4 * ph_grade(ph) + 3 * tds_grade(tds) + 3 * turbidity_grade(turbidity)
    return (F.when(s10 >= 25, 3).when(s10 >= 15, 2).when(s10 >= 5, 1)
            .otherwise(0)).cast("int")


def grade_sum(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    return ph_grade(ph) + tds_grade(tds) + turbidity_grade(turbidity)


def rule_class(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """Rule class int(round(s / 3)) with s the grade sum.  Python rounds
    half to even, and s / 3 is never a tie, so it equals floor((s+1)/3)."""
    s = grade_sum(tds, turbidity, ph)
    return F.least(F.greatest(F.floor((s + 1) / 3), F.lit(0)), F.lit(3)).cast("int")


def ph_grade_fine(ph="ph") -> Column:
    """0-4 pH grade with half steps (confidence booster)."""
    p = col(ph)
    return (F.when(p.between(7.0, 7.5), 4.0).when(p.between(6.8, 7.8), 3.5)
            .when(p.between(6.5, 8.5), 3.0).when(p.between(6.0, 9.0), 2.0)
            .when(p.between(5.5, 9.5), 1.0).otherwise(0.0))


def tds_grade_fine(tds="tds") -> Column:
    t = col(tds)
    return (F.when(t <= 150, 4.0).when(t <= 300, 3.5).when(t <= 500, 3.0)
            .when(t <= 800, 2.0).when(t <= 1200, 1.0).otherwise(0.0))


def turbidity_grade_fine(turbidity="turbidity") -> Column:
    u = col(turbidity)
    return (F.when(u <= 0.5, 4.0).when(u <= 1.0, 3.5).when(u <= 3.0, 3.0)
            .when(u <= 8.0, 2.0).when(u <= 15.0, 1.0).otherwise(0.0))
