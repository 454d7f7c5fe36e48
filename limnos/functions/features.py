"""The 32 engineered features (F1-F32) as built-in column expressions.

All features are row-local with fixed constants, so the whole stage is
shuffle-free (three staged projections in one pipeline), identical in batch
and streaming.  Features
are defined for valid readings; invalid rows are routed out first
(``operators.validate``).
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import col


def _row_mean(a: Column, b: Column, c: Column) -> Column:
    return (a + b + c) / 3.0


def _row_var_samp(a: Column, b: Column, c: Column) -> Column:
    m = _row_mean(a, b, c)
    return ((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 2.0


def who_indices(t: Column, u: Column, p: Column) -> "OrderedDict[str, Column]":
    dp = F.abs(p - 7.25)
    ph_i = (F.when(p.between(7.0, 7.5), F.lit(100.0))
            .when(p.between(6.5, 8.5), 100.0 - dp * 20)
            .when(p.between(6.0, 9.0), 70.0 - dp * 15)
            .otherwise(F.greatest(F.lit(0.0), 30.0 - dp * 10)))
    tds_i = (F.when(t <= 300, F.lit(100.0))
             .when(t <= 600, 100.0 - (t - 300) / 3)
             .when(t <= 900, 70.0 - (t - 600) / 6)
             .otherwise(F.greatest(F.lit(0.0), 20.0 - (t - 900) / 20)))
    turb_i = (F.when(u <= 1, F.lit(100.0))
              .when(u <= 5, 100.0 - (u - 1) * 10)
              .when(u <= 10, 60.0 - (u - 5) * 8)
              .otherwise(F.greatest(F.lit(0.0), 20.0 - (u - 10) * 2)))
    return OrderedDict([
        ("who_ph_index", ph_i),
        ("who_tds_index", tds_i),
        ("who_turbidity_index", turb_i),
        ("who_wqi", F.pow(ph_i * tds_i * turb_i, 1.0 / 3)),
    ])


def ccme_wqi(t: Column, u: Column, p: Column) -> Column:
    """CCME index with the reference's extra x100 on F3 (quirk Q-4)."""
    ph_bad = (p < 6.5) | (p > 8.5)
    k = ph_bad.cast("int") + (t > 500).cast("int") + (u > 5).cast("int")
    f12 = k / 3.0 * 100
    ex = (F.coalesce(F.when(p < 6.5, (6.5 - p) / 6.5).when(p > 8.5, (p - 8.5) / 8.5), F.lit(0.0))
          + F.coalesce(F.when(t > 500, (t - 500) / 500), F.lit(0.0))
          + F.coalesce(F.when(u > 5, (u - 5) / 5), F.lit(0.0)))
    nse = ex / F.when(k > 0, k)
    f3 = F.coalesce(nse / (0.01 * nse + 0.01) * 100, F.lit(0.0))
    raw = 100.0 - F.sqrt(f12 * f12 + f12 * f12 + f3 * f3) / 1.732
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def cpi(t: Column, u: Column, p: Column) -> Column:
    ph_pol = (F.when(p < 6.5, (6.5 - p) / 2.5).when(p > 8.5, (p - 8.5) / 3.5)
              .otherwise(F.lit(0.0)))
    return (0.3 * ph_pol + 0.5 * F.least(F.lit(1.0), t / 2000)
            + 0.2 * F.least(F.lit(1.0), u / 50)) * 100


def interactions(t: Column, u: Column, p: Column) -> "OrderedDict[str, Column]":
    lt, lu = F.log1p(t), F.log1p(u)
    return OrderedDict([
        ("ph_tds_product", p * lt),
        ("ph_tds_ratio", p / (t / 100 + 1)),
        ("tds_turbidity_product", lt * lu),
        ("tds_turbidity_ratio", t / (u + 1)),
        ("ph_turbidity_product", p * lu),
        ("ph_turbidity_diff", F.abs(p - 7) * u),
        ("ph_tds_turbidity_index", p * lt * lu),
    ])


def risk_features(t: Column, u: Column, p: Column) -> "OrderedDict[str, Column]":
    d = F.abs(p - 7.25)
    ph_r = F.when(d > 1.25, F.greatest(F.lit(0.0), (d - 1.25) / 2.75)).otherwise(F.lit(0.0))
    tds_r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - 300) / 1700))
    tu_r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (u - 1) / 49))
    return OrderedDict([
        ("ph_risk", ph_r),
        ("tds_risk", tds_r),
        ("turbidity_risk", tu_r),
        ("total_risk_score", ph_r + tds_r + tu_r),
        ("max_risk_score", F.greatest(ph_r, tds_r, tu_r)),
        ("risk_variance", _row_var_samp(ph_r, tds_r, tu_r)),
        ("high_risk_count", ((ph_r > 0.5).cast("int") + (tds_r > 0.5).cast("int")
                             + (tu_r > 0.5).cast("int"))),
    ])


def stat_features(t: Column, u: Column, p: Column) -> "OrderedDict[str, Column]":
    zp, zt, zu = (p - 7.0) / 1.0, (t - 500) / 400, (u - 5) / 10
    return OrderedDict([
        ("ph_zscore", zp),
        ("tds_zscore", zt),
        ("turbidity_zscore", zu),
        ("ph_deviation", F.abs(p - 7.0)),
        ("tds_deviation", F.abs(t - 150)),
        ("turbidity_deviation", u),
        ("param_mean", _row_mean(zp, zt, zu)),
        ("param_std", F.sqrt(_row_var_samp(zp, zt, zu))),
        ("param_range", F.greatest(zp, zt, zu) - F.least(zp, zt, zu)),
    ])


def health_scores(t: Column, u: Column, p: Column) -> "OrderedDict[str, Column]":
    ph_ded = F.when((p < 6.5) | (p > 8.5), 30).when((p < 6.8) | (p > 8.2), 15).otherwise(0)
    tds_ded = F.when(t > 1000, 40).when(t > 500, 20).when(t < 50, 10).otherwise(0)
    tu_ded = F.when(u > 10, 30).when(u > 4, 15).otherwise(0)
    safety = F.greatest(F.lit(0), 100 - ph_ded - tds_ded - tu_ded)
    dp = F.abs(p - 7.0)
    aes = (100.0 - F.when(dp > 0.5, dp * 20).otherwise(F.lit(0.0))
           - F.when(t > 300, (t - 300) / 20).when(t < 100, (100 - t) / 10).otherwise(F.lit(0.0))
           - u * 10)
    difficulty = dp * 10 + F.when(t > 1000, (t - 1000) / 50).otherwise(F.lit(0.0)) + u * 2
    return OrderedDict([
        ("drinking_safety_score", safety.cast("int")),
        ("aesthetic_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), aes))),
        ("treatment_difficulty", F.least(F.lit(100.0), difficulty)),
    ])


FEATURE_GROUPS = ("who", "ccme", "cpi", "interactions", "risk", "stats", "health")


def feature_columns(tds="tds", turbidity="turbidity", ph="ph",
                    groups=FEATURE_GROUPS) -> "OrderedDict[str, Column]":
    """Name -> Column for the engineered features, in emission order."""
    t, u, p = col(tds), col(turbidity), col(ph)
    out: "OrderedDict[str, Column]" = OrderedDict()
    if "who" in groups:
        out.update(who_indices(t, u, p))
    if "ccme" in groups:
        out["ccme_wqi"] = ccme_wqi(t, u, p)
    if "cpi" in groups:
        out["cpi"] = cpi(t, u, p)
    if "interactions" in groups:
        out.update(interactions(t, u, p))
    if "risk" in groups:
        out.update(risk_features(t, u, p))
    if "stats" in groups:
        out.update(stat_features(t, u, p))
    if "health" in groups:
        out.update(health_scores(t, u, p))
    return out


# Emission order of the 32 engineered columns (a name list, so importing
# this module needs no Spark session).
ENGINEERED_FEATURES = [
    "who_ph_index", "who_tds_index", "who_turbidity_index", "who_wqi", "ccme_wqi", "cpi",
    "ph_tds_product", "ph_tds_ratio", "tds_turbidity_product", "tds_turbidity_ratio",
    "ph_turbidity_product", "ph_turbidity_diff", "ph_tds_turbidity_index",
    "ph_risk", "tds_risk", "turbidity_risk", "total_risk_score", "max_risk_score",
    "risk_variance", "high_risk_count",
    "ph_zscore", "tds_zscore", "turbidity_zscore", "ph_deviation", "tds_deviation",
    "turbidity_deviation", "param_mean", "param_std", "param_range",
    "drinking_safety_score", "aesthetic_score", "treatment_difficulty",
]
MODEL_FEATURES = ["tds", "turbidity", "ph"] + ENGINEERED_FEATURES

# Feature descriptions published by the reference.
FEATURE_DESCRIPTIONS = {
    "who_wqi": "WHO Water Quality Index (0-100)",
    "ccme_wqi": "Canadian Water Quality Index (0-100)",
    "cpi": "Comprehensive Pollution Index (0-100)",
    "drinking_safety_score": "Drinking Water Safety Score (0-100)",
    "aesthetic_score": "Water Aesthetic Quality Score (0-100)",
    "treatment_difficulty": "Water Treatment Difficulty Index (0-100)",
    "total_risk_score": "Total Parameter Risk Score",
    "ph_tds_product": "pH-TDS Interaction Feature",
    "tds_turbidity_ratio": "TDS-Turbidity Ratio Feature",
    "param_std": "Parameter Variability Measure",
}


def _staged(df: DataFrame, groups) -> DataFrame:
    """The features as three projections.  Later stages refer to earlier
    outputs by name, so no sub-expression is copied into another feature's
    tree (CollapseProject keeps a shared non-trivial expression in its own
    projection).  What no other feature needs comes last, with the variances:
    those fold an array, so this projection is not fused with the others into
    one method, which would be too long for the JVM to compile."""
    t, u, p = F.col("tds"), F.col("turbidity"), F.col("ph")
    a = OrderedDict()
    if "who" in groups:
        a.update(list(who_indices(t, u, p).items())[:3])
    if "risk" in groups:
        a.update(list(risk_features(t, u, p).items())[:3])
    if "stats" in groups:
        st = stat_features(t, u, p)
        for n in ("ph_zscore", "tds_zscore", "turbidity_zscore"):
            a[n] = st[n]
    df = df.select("*", *[c.alias(n) for n, c in a.items()])
    b = OrderedDict()
    if "who" in groups:
        b["who_wqi"] = F.pow(F.col("who_ph_index") * F.col("who_tds_index")
                             * F.col("who_turbidity_index"), 1.0 / 3)
    if "risk" in groups:
        r1, r2, r3 = F.col("ph_risk"), F.col("tds_risk"), F.col("turbidity_risk")
        b["total_risk_score"] = r1 + r2 + r3
        b["max_risk_score"] = F.greatest(r1, r2, r3)
        b["high_risk_count"] = ((r1 > 0.5).cast("int") + (r2 > 0.5).cast("int")
                                + (r3 > 0.5).cast("int"))
    if "stats" in groups:
        b["param_mean"] = _row_mean(F.col("ph_zscore"), F.col("tds_zscore"),
                                    F.col("turbidity_zscore"))
    df = df.select("*", *[c.alias(n) for n, c in b.items()])

    def variance(names, m):
        return F.aggregate(F.array(*names), F.lit(0.0), lambda total, x: total + (x - m) * (x - m)) / 2.0

    c3 = OrderedDict()
    if "ccme" in groups:
        c3["ccme_wqi"] = ccme_wqi(t, u, p)
    if "cpi" in groups:
        c3["cpi"] = cpi(t, u, p)
    if "interactions" in groups:
        c3.update(interactions(t, u, p))
    if "health" in groups:
        c3.update(health_scores(t, u, p))
    if "risk" in groups:
        m = F.col("total_risk_score") / 3.0
        c3["risk_variance"] = variance(("ph_risk", "tds_risk", "turbidity_risk"), m)
    if "stats" in groups:
        zs = [F.col("ph_zscore"), F.col("tds_zscore"), F.col("turbidity_zscore")]
        c3.update((n, st[n]) for n in ("ph_deviation", "tds_deviation", "turbidity_deviation"))
        c3["param_std"] = F.sqrt(variance(zs, F.col("param_mean")))
        c3["param_range"] = F.greatest(*zs) - F.least(*zs)
    return df.select("*", *[c.alias(n) for n, c in c3.items()])


def engineer_features(df: DataFrame, groups=FEATURE_GROUPS) -> DataFrame:
    """Append the engineered features in emission order (three staged
    projections, see ``_staged``).  Descriptions ride along as column
    metadata."""
    base = list(df.columns)
    staged = _staged(df, groups)
    names = [n for n in feature_columns(groups=groups)]
    assert len(ENGINEERED_FEATURES) == 32
    return staged.select(*base, *[
        F.col(n).alias(n, metadata={"description": FEATURE_DESCRIPTIONS[n]})
        if n in FEATURE_DESCRIPTIONS else F.col(n) for n in names])


def new_columns(before: DataFrame, after: DataFrame) -> list:
    """Which columns a stage added (driver-side, schema only)."""
    return [c for c in after.columns if c not in set(before.columns)]
