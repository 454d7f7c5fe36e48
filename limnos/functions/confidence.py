"""Confidence operators (E2-E12): pure functions of the reading, the model
class and the probability row.  Sub-scores are plain columns, so the whole
chain is one codegen projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col
from .arrays import argmax, certainty, top_prob
from .grades import (ph_grade, ph_grade_fine, rule_class, tds_grade, tds_grade_fine,
                     turbidity_grade, turbidity_grade_fine)

# Booster multipliers.
MULT_EXCELLENT = 1.35
MULT_GOOD = 1.25
MULT_CONSISTENT = 1.20
MULT_STANDARDS = 1.15
MULT_SYNERGY = 1.10
MULT_CLEAR = 1.12
BOOST_CAP = 0.98


def parameter_consistency(tds, turbidity, ph, model_class, fix_tds: bool = False) -> Column:
    """E3.  Like the reference, the TDS grade is taken of the *turbidity*
    value (quirk Q-1) unless ``fix_tds``."""
    t, u, p, c = col(tds), col(turbidity), col(ph), col(model_class)
    g_t = tds_grade(t if fix_tds else u)
    avg = (ph_grade(p) + g_t + turbidity_grade(u)) / 3.0
    gap = F.abs(avg - c)
    base = 1.0 - gap / 3.0
    out = F.when(gap < 0.5, F.least(F.lit(1.0), base + 0.2)).otherwise(base)
    return F.greatest(F.lit(0.0), out)


def standards_enhance(tds, turbidity, ph, model_class, base_conf) -> Column:
    """struct<confidence double, quality_class int>."""
    c, b = col(model_class), col(base_conf)
    rc = rule_class(tds, turbidity, ph)
    cons = parameter_consistency(tds, turbidity, ph, c)
    near = F.abs(rc - c) <= 1
    e = F.least(F.lit(0.95), b + (0.15 + cons * 0.25))
    e = F.when(rc == c, F.least(F.lit(0.95), e + 0.1)).otherwise(e)
    total = b + cons
    far_conf = (F.when(total > 0, F.when(cons > b * 1.5, F.least(F.lit(0.85), 0.6 + cons * 0.25))
                       .otherwise(F.least(F.lit(0.75), b + 0.1)))
                .otherwise(b))
    far_cls = F.when((total > 0) & (cons > b * 1.5), rc).otherwise(c)
    return F.struct(F.when(near, e).otherwise(far_conf).alias("confidence"),
                    F.when(near, c).otherwise(far_cls).cast("int").alias("quality_class"))


def grade_agreement(g1: Column, g2: Column, g3: Column) -> Column:
    """Population std of the three fine grades -> 0..1."""
    m = (g1 + g2 + g3) / 3.0
    sd = F.sqrt(((g1 - m) * (g1 - m) + (g2 - m) * (g2 - m) + (g3 - m) * (g3 - m)) / 3.0)
    c = F.greatest(F.lit(0.0), 1 - sd / 2.0)
    return F.when(sd < 0.5, F.least(F.lit(1.0), c + 0.2)).otherwise(c)


def standards_class(g1: Column, g2: Column, g3: Column) -> Column:
    """Mean of (3 - grade/4*3), clamped to [0, 3] (inverted scale, Q-2)."""
    q = ((3 - g1 / 4.0 * 3) + (3 - g2 / 4.0 * 3) + (3 - g3 / 4.0 * 3)) / 3.0
    return F.greatest(F.lit(0.0), F.least(F.lit(3.0), q))


def synergy(g_ph: Column, g_tds: Column, g_tu: Column) -> Column:
    """E9."""
    s = (F.when((g_ph >= 3) & (g_tds >= 3), 0.4).when((g_ph <= 1) & (g_tds <= 1), 0.3).otherwise(0.0)
         + F.when((g_tds >= 3) & (g_tu >= 3), 0.4).when((g_tds <= 1) & (g_tu <= 1), 0.3).otherwise(0.0)
         + F.when((g_ph >= 3) & (g_tu >= 3), 0.2).otherwise(0.0))
    return F.least(F.lit(1.0), s)


def clear_case(tds, turbidity, ph, model_class) -> Column:
    """E10."""
    t, u, p, c = col(tds), col(turbidity), col(ph), col(model_class)
    return (((t <= 200) & (u <= 1) & p.between(7.0, 7.5) & (c == 3))
            | (((t >= 1200) | (u >= 15) | (p <= 5.5) | (p >= 9.5)) & (c == 0))
            | ((t >= 1000) & (u >= 8) & (c <= 1)))


def boost(tds, turbidity, ph, model_class, conf, probability) -> Column:
    """Product of bonus multipliers, capped at 0.98."""
    t, u, p, c = col(tds), col(turbidity), col(ph), col(model_class)
    g1, g2, g3 = ph_grade_fine(p), tds_grade_fine(t), turbidity_grade_fine(u)
    avg = (g1 + g2 + g3) / 3.0
    cert = certainty(probability)
    m_quality = F.when(avg >= 3.5, MULT_EXCELLENT).when(avg >= 2.5, MULT_GOOD).otherwise(1.0)
    m_cons = F.when(grade_agreement(g1, g2, g3) > 0.8, MULT_CONSISTENT).otherwise(1.0)
    m_std = F.when(F.abs(standards_class(g1, g2, g3) - c) <= 0.5, MULT_STANDARDS).otherwise(1.0)
    m_syn = F.when(synergy(g1, g2, g3) > 0.7, MULT_SYNERGY).otherwise(1.0)
    m_cert = F.when(cert > 0.6, 1 + (cert - 0.6) * 0.3).otherwise(1.0)
    m_clear = F.when(clear_case(t, u, p, c), MULT_CLEAR).otherwise(1.0)
    e = col(conf) * m_quality * m_cons * m_std * m_syn * m_cert * m_clear
    return F.least(F.lit(BOOST_CAP), e)


def final_prediction(tds="tds", turbidity="turbidity", ph="ph",
                     probability="probability") -> Column:
    """E12 wiring as one struct: model class and base confidence from the
    probability row, standards enhancement, booster on the *model* class
    (Q-3), adjusted class shown, ``enhancement_applied = final > base``."""
    probs = col(probability)
    mc = argmax(probs)
    base = top_prob(probs)
    enh = standards_enhance(tds, turbidity, ph, mc, base)
    final_conf = boost(tds, turbidity, ph, mc, enh["confidence"], probs)
    return F.struct(mc.alias("model_class"), base.alias("base_confidence"),
                    enh["confidence"].alias("standards_confidence"),
                    enh["quality_class"].alias("quality_class"),
                    final_conf.alias("confidence"),
                    (final_conf > base).alias("enhancement_applied"))
