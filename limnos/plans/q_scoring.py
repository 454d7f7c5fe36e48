"""Indices, rule classifiers and text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.indices import (demo_class, demo_confidence, demo_score, overall_assessment,
                                 wqi_service, wqi_simple)
from . import query
from .common import labelled, r, valid
from .sql import BASE, READINGS, VALID, with_

VBASE = with_(READINGS, VALID)

SIMPLE_WQI_SQL = """least(100e0, greatest(0e0,
    (greatest(0e0, 100 - abs(ph - 7) * 20) * 0.4e0 + greatest(0e0, 100 - tds / 10) * 0.3e0
     + greatest(0e0, 100 - turbidity * 10) * 0.3e0) / 1.0e0))"""

SERVICE_WQI_SQL = """least(100e0, greatest(0e0,
    (CASE WHEN ph BETWEEN 7.0 AND 7.5 THEN 100e0
          WHEN ph BETWEEN 6.5 AND 8.5 THEN 80 - abs(ph - 7.25) * 20
          WHEN ph BETWEEN 6.0 AND 9.0 THEN 60 - abs(ph - 7.25) * 10
          ELSE greatest(0e0, 40 - abs(ph - 7.25) * 10) END) * 0.4e0
  + (CASE WHEN tds <= 300 THEN 100e0 WHEN tds <= 600 THEN 100 - (tds - 300) / 3
          WHEN tds <= 900 THEN 60 - (tds - 600) / 7.5
          ELSE greatest(0e0, 20 - (tds - 900) / 50) END) * 0.3e0
  + (CASE WHEN turbidity <= 1 THEN 100e0 WHEN turbidity <= 4 THEN 100 - (turbidity - 1) * 10
          WHEN turbidity <= 10 THEN 60 - (turbidity - 4) * 5
          ELSE greatest(0e0, 30 - (turbidity - 10) * 3) END) * 0.3e0))"""

ASSESS_SQL = """CASE WHEN {c} >= 2 AND {w} >= 70 THEN 'Safe for consumption with excellent/good quality indicators'
     WHEN {c} >= 1 AND {w} >= 50 THEN 'Generally safe for consumption with regular monitoring recommended'
     ELSE 'Treatment or filtration recommended before consumption' END"""


@query("c03_wqi_simple", VBASE + f"SELECT reading_id, round({SIMPLE_WQI_SQL}, 6) AS wqi FROM valid")
def c03_wqi_simple(spark, sf_dir):
    """Simple WQI per valid reading."""
    return valid(spark, sf_dir).select("reading_id", r(wqi_simple()).alias("wqi"))


@query("c04_wqi_service", VBASE + f"SELECT reading_id, round({SERVICE_WQI_SQL}, 6) AS wqi FROM valid")
def c04_wqi_service(spark, sf_dir):
    """C4: the service WQI per valid reading."""
    return valid(spark, sf_dir).select("reading_id", r(wqi_service()).alias("wqi"))


@query("c05_overall_assessment", BASE + f"""
SELECT reading_id, {ASSESS_SQL.format(c='quality', w=SERVICE_WQI_SQL)} AS assessment FROM labelled""")
def c05_overall_assessment(spark, sf_dir):
    """Assessment text from the quality class and the service WQI."""
    return labelled(spark, sf_dir).select(
        "reading_id", overall_assessment("quality", wqi_service()).alias("assessment"))


DEMO_SQL = """
  (CASE WHEN ph BETWEEN 7.0 AND 7.5 THEN 40 WHEN ph BETWEEN 6.5 AND 8.5 THEN 30
        WHEN ph BETWEEN 6.0 AND 9.0 THEN 20 ELSE 10 END)
  + (CASE WHEN tds <= 300 THEN 35 WHEN tds <= 600 THEN 25 WHEN tds <= 900 THEN 15 ELSE 5 END)
  + (CASE WHEN turbidity <= 1 THEN 25 WHEN turbidity <= 4 THEN 20 WHEN turbidity <= 10 THEN 10
          ELSE 5 END)"""


@query("c06_demo_classifier", VBASE + f"""
SELECT reading_id, quality_class, confidence, score / 100e0 AS prediction_score, score AS wqi_score,
       {ASSESS_SQL.format(c='quality_class', w='score')} AS assessment
FROM (SELECT reading_id, score,
             CAST(CASE WHEN score >= 80 THEN 3 WHEN score >= 65 THEN 2 WHEN score >= 45 THEN 1
                       ELSE 0 END AS INTEGER) AS quality_class,
             CASE WHEN score >= 80 THEN 0.9e0 WHEN score >= 65 THEN 0.8e0 WHEN score >= 45 THEN 0.7e0
                  ELSE 0.6e0 END AS confidence
      FROM (SELECT reading_id, CAST({DEMO_SQL} AS INTEGER) AS score FROM valid))""")
def c06_demo_classifier(spark, sf_dir):
    """Point-score classifier with fixed confidences and assessment."""
    s = valid(spark, sf_dir).withColumn("score", demo_score())
    return s.select("reading_id", demo_class("score").alias("quality_class"),
                    demo_confidence("score").alias("confidence"),
                    (F.col("score") / 100.0).alias("prediction_score"),
                    F.col("score").alias("wqi_score"),
                    overall_assessment(demo_class("score"), F.col("score")).alias("assessment"))


@query("c08_parameter_analysis", VBASE + """
SELECT reading_id,
  CASE WHEN ph < 6.5 THEN 'Acidic (' || CAST(ph AS VARCHAR) || ') - may cause corrosion'
       WHEN ph > 8.5 THEN 'Alkaline (' || CAST(ph AS VARCHAR) || ') - may cause scaling'
       ELSE 'Within acceptable range (' || CAST(ph AS VARCHAR) || ')' END AS ph_analysis,
  CASE WHEN tds > 1000 THEN 'High TDS (' || CAST(tds AS VARCHAR) || ' mg/L) - may affect taste'
       WHEN tds < 50 THEN 'Very low TDS (' || CAST(tds AS VARCHAR) || ' mg/L) - may lack minerals'
       ELSE 'Acceptable TDS level (' || CAST(tds AS VARCHAR) || ' mg/L)' END AS tds_analysis,
  CASE WHEN turbidity > 4
       THEN 'High turbidity (' || CAST(turbidity AS VARCHAR) || ' NTU) - filtration recommended'
       ELSE 'Acceptable clarity (' || CAST(turbidity AS VARCHAR) || ' NTU)' END AS turbidity_analysis
FROM valid""")
def c08_parameter_analysis(spark, sf_dir):
    """The parameter-analysis map, one column per key."""
    m = text.parameter_analysis()
    return valid(spark, sf_dir).select(
        "reading_id", m["ph"].alias("ph_analysis"), m["tds"].alias("tds_analysis"),
        m["turbidity"].alias("turbidity_analysis"))


@query("c09_graded_parameter_text", VBASE + r"""
SELECT reading_id,
  (CASE WHEN ph BETWEEN 7.0 AND 7.5 THEN '- pH: Optimal range (7.0-7.5)' || chr(10)
        WHEN ph BETWEEN 6.5 AND 8.5 THEN '- pH: Acceptable range (6.5-8.5)' || chr(10)
        ELSE '- pH: Outside acceptable range (6.5-8.5) - requires attention' || chr(10) END)
  || (CASE WHEN tds <= 300 THEN '- TDS: Excellent (<300 mg/L)' || chr(10)
           WHEN tds <= 600 THEN '- TDS: Good (300-600 mg/L)' || chr(10)
           WHEN tds <= 900 THEN '- TDS: Acceptable (600-900 mg/L)' || chr(10)
           ELSE '- TDS: Poor (>900 mg/L) - treatment recommended' || chr(10) END)
  || (CASE WHEN turbidity <= 1 THEN '- Turbidity: Excellent (<1 NTU)' || chr(10)
           WHEN turbidity <= 4 THEN '- Turbidity: Good (1-4 NTU)' || chr(10)
           WHEN turbidity <= 10 THEN '- Turbidity: Acceptable (4-10 NTU)' || chr(10)
           ELSE '- Turbidity: Poor (>10 NTU) - filtration needed' || chr(10) END) AS analysis
FROM valid""")
def c09_graded_parameter_text(spark, sf_dir):
    """The graded parameter lines of the text report."""
    return valid(spark, sf_dir).select("reading_id", text.graded_lines().alias("analysis"))


@query("c10_parameter_status", VBASE + """
SELECT reading_id,
  CASE WHEN ph BETWEEN 7.0 AND 7.5 THEN '✅ Optimal' WHEN ph BETWEEN 6.5 AND 8.5 THEN '✅ Good'
       ELSE '⚠️ Needs attention' END AS ph_status,
  CASE WHEN tds <= 300 THEN '✅ Excellent' WHEN tds <= 600 THEN '✅ Good'
       WHEN tds <= 900 THEN '⚠️ Acceptable' ELSE '❌ High' END AS tds_status,
  CASE WHEN turbidity <= 1 THEN '✅ Excellent' WHEN turbidity <= 4 THEN '✅ Good'
       WHEN turbidity <= 10 THEN '⚠️ Acceptable' ELSE '❌ High' END AS turbidity_status
FROM valid""")
def c10_parameter_status(spark, sf_dir):
    """Status badges per parameter."""
    return valid(spark, sf_dir).select("reading_id", text.ph_status().alias("ph_status"),
                                       text.tds_status().alias("tds_status"),
                                       text.turbidity_status().alias("turbidity_status"))
