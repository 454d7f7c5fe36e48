"""Engineered features F1-F32 (shuffle-free projections)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import engineer_features, feature_columns
from . import query
from .common import r, rounded, valid
from .sql import READINGS, READINGS_LINEITEM, VALID, with_

# Oracle restatement of the features (DuckDB lateral column aliases).
FEATURE_SQL = """
  CASE WHEN ph BETWEEN 7.0 AND 7.5 THEN 100e0
       WHEN ph BETWEEN 6.5 AND 8.5 THEN 100 - abs(ph - 7.25) * 20
       WHEN ph BETWEEN 6.0 AND 9.0 THEN 70 - abs(ph - 7.25) * 15
       ELSE greatest(0e0, 30 - abs(ph - 7.25) * 10) END AS who_ph_index,
  CASE WHEN tds <= 300 THEN 100e0 WHEN tds <= 600 THEN 100 - (tds - 300) / 3
       WHEN tds <= 900 THEN 70 - (tds - 600) / 6
       ELSE greatest(0e0, 20 - (tds - 900) / 20) END AS who_tds_index,
  CASE WHEN turbidity <= 1 THEN 100e0 WHEN turbidity <= 5 THEN 100 - (turbidity - 1) * 10
       WHEN turbidity <= 10 THEN 60 - (turbidity - 5) * 8
       ELSE greatest(0e0, 20 - (turbidity - 10) * 2) END AS who_turbidity_index,
  pow(who_ph_index * who_tds_index * who_turbidity_index, 1e0 / 3) AS who_wqi,
  (CASE WHEN ph < 6.5 OR ph > 8.5 THEN 1 ELSE 0 END) + (CASE WHEN tds > 500 THEN 1 ELSE 0 END)
    + (CASE WHEN turbidity > 5 THEN 1 ELSE 0 END) AS _k,
  _k / 3e0 * 100 AS _f1,
  (CASE WHEN ph < 6.5 THEN (6.5 - ph) / 6.5 WHEN ph > 8.5 THEN (ph - 8.5) / 8.5 ELSE 0e0 END)
    + (CASE WHEN tds > 500 THEN (tds - 500) / 500 ELSE 0e0 END)
    + (CASE WHEN turbidity > 5 THEN (turbidity - 5) / 5 ELSE 0e0 END) AS _ex,
  CASE WHEN _k > 0 THEN (_ex / _k) / (0.01 * (_ex / _k) + 0.01) * 100 ELSE 0e0 END AS _f3,
  greatest(0e0, least(100e0, 100 - sqrt(_f1 * _f1 + _f1 * _f1 + _f3 * _f3) / 1.732)) AS ccme_wqi,
  (0.3 * (CASE WHEN ph < 6.5 THEN (6.5 - ph) / 2.5 WHEN ph > 8.5 THEN (ph - 8.5) / 3.5 ELSE 0e0 END)
    + 0.5 * least(1e0, tds / 2000) + 0.2 * least(1e0, turbidity / 50)) * 100 AS cpi,
  ph * ln(1 + tds) AS ph_tds_product,
  ph / (tds / 100 + 1) AS ph_tds_ratio,
  ln(1 + tds) * ln(1 + turbidity) AS tds_turbidity_product,
  tds / (turbidity + 1) AS tds_turbidity_ratio,
  ph * ln(1 + turbidity) AS ph_turbidity_product,
  abs(ph - 7) * turbidity AS ph_turbidity_diff,
  ph * ln(1 + tds) * ln(1 + turbidity) AS ph_tds_turbidity_index,
  CASE WHEN abs(ph - 7.25) > 1.25 THEN greatest(0e0, (abs(ph - 7.25) - 1.25) / 2.75)
       ELSE 0e0 END AS ph_risk,
  least(1e0, greatest(0e0, (tds - 300) / 1700)) AS tds_risk,
  least(1e0, greatest(0e0, (turbidity - 1) / 49)) AS turbidity_risk,
  ph_risk + tds_risk + turbidity_risk AS total_risk_score,
  greatest(ph_risk, tds_risk, turbidity_risk) AS max_risk_score,
  (pow(ph_risk - total_risk_score / 3, 2) + pow(tds_risk - total_risk_score / 3, 2)
    + pow(turbidity_risk - total_risk_score / 3, 2)) / 2 AS risk_variance,
  CAST((ph_risk > 0.5)::INTEGER + (tds_risk > 0.5)::INTEGER + (turbidity_risk > 0.5)::INTEGER
       AS INTEGER) AS high_risk_count,
  ph - 7e0 AS ph_zscore,
  (tds - 500) / 400 AS tds_zscore,
  (turbidity - 5) / 10 AS turbidity_zscore,
  abs(ph - 7) AS ph_deviation,
  abs(tds - 150) AS tds_deviation,
  turbidity AS turbidity_deviation,
  (ph_zscore + tds_zscore + turbidity_zscore) / 3 AS param_mean,
  sqrt((pow(ph_zscore - param_mean, 2) + pow(tds_zscore - param_mean, 2)
        + pow(turbidity_zscore - param_mean, 2)) / 2) AS param_std,
  greatest(ph_zscore, tds_zscore, turbidity_zscore)
    - least(ph_zscore, tds_zscore, turbidity_zscore) AS param_range,
  CAST(greatest(0, 100
    - CASE WHEN ph < 6.5 OR ph > 8.5 THEN 30 WHEN ph < 6.8 OR ph > 8.2 THEN 15 ELSE 0 END
    - CASE WHEN tds > 1000 THEN 40 WHEN tds > 500 THEN 20 WHEN tds < 50 THEN 10 ELSE 0 END
    - CASE WHEN turbidity > 10 THEN 30 WHEN turbidity > 4 THEN 15 ELSE 0 END) AS INTEGER)
    AS drinking_safety_score,
  greatest(0e0, least(100e0, 100e0
    - CASE WHEN abs(ph - 7) > 0.5 THEN abs(ph - 7) * 20 ELSE 0e0 END
    - CASE WHEN tds > 300 THEN (tds - 300) / 20 WHEN tds < 100 THEN (100 - tds) / 10 ELSE 0e0 END
    - turbidity * 10)) AS aesthetic_score,
  least(100e0, abs(ph - 7) * 10 + CASE WHEN tds > 1000 THEN (tds - 1000) / 50 ELSE 0e0 END
    + turbidity * 2) AS treatment_difficulty
"""

FEATURES = with_(READINGS, VALID, f"feat AS (SELECT *, {FEATURE_SQL} FROM valid)")

GROUPS = {
    "f01_who_wqi": ("who", ["who_ph_index", "who_tds_index", "who_turbidity_index", "who_wqi"]),
    "f05_ccme_wqi": ("ccme", ["ccme_wqi"]),
    "f06_cpi": ("cpi", ["cpi"]),
    "f07_interactions": ("interactions", ["ph_tds_product", "ph_tds_ratio", "tds_turbidity_product",
                                          "tds_turbidity_ratio", "ph_turbidity_product",
                                          "ph_turbidity_diff", "ph_tds_turbidity_index"]),
    "f14_risk_features": ("risk", ["ph_risk", "tds_risk", "turbidity_risk", "total_risk_score",
                                   "max_risk_score", "risk_variance", "high_risk_count"]),
    "f21_stat_features": ("stats", ["ph_zscore", "tds_zscore", "turbidity_zscore", "ph_deviation",
                                    "tds_deviation", "turbidity_deviation", "param_mean",
                                    "param_std", "param_range"]),
    "f30_health_scores": ("health", ["drinking_safety_score", "aesthetic_score",
                                     "treatment_difficulty"]),
}
INT_FEATURES = {"high_risk_count", "drinking_safety_score"}


def _sql_select(cols):
    return ", ".join(c if c in INT_FEATURES else f"round({c}, 6) AS {c}" for c in cols)


def _make(name, group, cols):
    def fn(spark, sf_dir):
        df = engineer_features(valid(spark, sf_dir), groups=(group,))
        return df.select("reading_id", *[(F.col(c) if c in INT_FEATURES else r(c)).alias(c)
                                         for c in cols])
    fn.__name__ = name
    fn.__doc__ = f"Engineered features ({group}): {', '.join(cols)}."
    query(name, FEATURES + f"SELECT reading_id, {_sql_select(cols)} FROM feat")(fn)


for _name, (_group, _cols) in GROUPS.items():
    _make(_name, _group, _cols)

ALL_COLS = [c for _, cs in GROUPS.values() for c in cs]
FLOAT_COLS = [c for c in ALL_COLS if c not in INT_FEATURES]


@query("f00_all_features", FEATURES + f"SELECT reading_id, tds, turbidity, ph, {_sql_select(ALL_COLS)} FROM feat")
def f00_all_features(spark, sf_dir):
    """F1-F32 in one projection (``engineer_features``): 35 model inputs."""
    df = valid(spark, sf_dir).transform(engineer_features)
    out = df.select("reading_id", "tds", "turbidity", "ph", *INT_FEATURES, *rounded(FLOAT_COLS))
    return out.select("reading_id", "tds", "turbidity", "ph", *ALL_COLS)


@query("f00_all_features_lineitem",
       with_(READINGS_LINEITEM, VALID, f"feat AS (SELECT *, {FEATURE_SQL} FROM valid)")
       + f"SELECT reading_id, {_sql_select(ALL_COLS)} FROM feat")
def f00_all_features_lineitem(spark, sf_dir):
    """F1-F32 over the lineitem readings (the volume table)."""
    df = valid(spark, sf_dir, "lineitem").transform(engineer_features)
    return df.select("reading_id", *INT_FEATURES, *rounded(FLOAT_COLS)).select("reading_id", *ALL_COLS)
