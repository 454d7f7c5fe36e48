"""Scoring chain: stand-in model -> E1-E12 -> records, texts and reports
(E1-E12, P13, C7, C11-C13, C15-C17, M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pct, text
from ..functions.arrays import certainty
from ..functions.confidence import (clear_case, grade_agreement, parameter_consistency,
                                    standards_class, synergy)
from ..functions.grades import ph_grade_fine, rule_class, tds_grade_fine, turbidity_grade_fine
from ..functions.indices import wqi_simple
from ..operators import profile
from ..operators.score import analysis_record, disagreeing_model, prediction_record, rule_model, score
from ..operators.validate import with_row_index
from ..sources.readings import readings
from . import query
from .common import r, valid
from .q_scoring import ASSESS_SQL, SERVICE_WQI_SQL, SIMPLE_WQI_SQL
from .sql import (G_PH, G_TDS, G_TU, LABEL_CASE, READINGS, READINGS_LINEITEM, VALID, VALID_WHERE,
                  py_round_sql, with_)

# -- oracle restatement of the chain ----------------------------------------
G_TDS_OF_TURB = G_TDS.replace("tds", "turbidity")

# One step a CTE, each materialised: nothing is expanded into later steps.
CHAIN_STEPS = [
    ("grades", f"""{G_PH} AS g_ph,
  {G_TDS} AS g_tds,
  {G_TU} AS g_tu,
  CASE WHEN ph BETWEEN 7.0 AND 7.5 THEN 4e0 WHEN ph BETWEEN 6.8 AND 7.8 THEN 3.5e0
       WHEN ph BETWEEN 6.5 AND 8.5 THEN 3e0 WHEN ph BETWEEN 6.0 AND 9.0 THEN 2e0
       WHEN ph BETWEEN 5.5 AND 9.5 THEN 1e0 ELSE 0e0 END AS f_ph,
  CASE WHEN tds <= 150 THEN 4e0 WHEN tds <= 300 THEN 3.5e0 WHEN tds <= 500 THEN 3e0
       WHEN tds <= 800 THEN 2e0 WHEN tds <= 1200 THEN 1e0 ELSE 0e0 END AS f_tds,
  CASE WHEN turbidity <= 0.5 THEN 4e0 WHEN turbidity <= 1.0 THEN 3.5e0 WHEN turbidity <= 3.0 THEN 3e0
       WHEN turbidity <= 8.0 THEN 2e0 WHEN turbidity <= 15.0 THEN 1e0 ELSE 0e0 END AS f_tu"""),
    ("averages", f"""(g_ph + g_tds + g_tu) / 3e0 AS w,
  CAST(round((g_ph + g_tds + g_tu) / 3e0) AS INTEGER) AS rule_class,
  (f_ph + f_tds + f_tu) / 3e0 AS f_avg,
  greatest(0e0, least(3e0, ((3 - f_ph / 4e0 * 3) + (3 - f_tds / 4e0 * 3) + (3 - f_tu / 4e0 * 3)) / 3e0))
    AS standards_class,
  least(1e0, CASE WHEN f_ph >= 3 AND f_tds >= 3 THEN 0.4e0 WHEN f_ph <= 1 AND f_tds <= 1 THEN 0.3e0 ELSE 0e0 END
           + CASE WHEN f_tds >= 3 AND f_tu >= 3 THEN 0.4e0 WHEN f_tds <= 1 AND f_tu <= 1 THEN 0.3e0 ELSE 0e0 END
           + CASE WHEN f_ph >= 3 AND f_tu >= 3 THEN 0.2e0 ELSE 0e0 END) AS synergy"""),
    ("distances", f"""exp(-2e0 * abs(w - 0)) AS e0_,
  exp(-2e0 * abs(w - 1)) AS e1_,
  exp(-2e0 * abs(w - 2)) AS e2_,
  exp(-2e0 * abs(w - 3)) AS e3_,
  sqrt(((f_ph - f_avg) * (f_ph - f_avg) + (f_tds - f_avg) * (f_tds - f_avg)
        + (f_tu - f_avg) * (f_tu - f_avg)) / 3e0) AS f_sd"""),
    ("weights", f"""e0_ + e1_ + e2_ + e3_ AS esum,
  CASE WHEN f_sd < 0.5e0 THEN least(1e0, greatest(0e0, 1 - f_sd / 2e0) + 0.2e0)
       ELSE greatest(0e0, 1 - f_sd / 2e0) END AS agreement"""),
    ("probabilities", f"""e0_ / esum AS p0,
  e1_ / esum AS p1,
  e2_ / esum AS p2,
  e3_ / esum AS p3"""),
    ("certainty", f"""greatest(p0, p1, p2, p3) AS base_confidence,
  least(1e0, (list_sort([p0, p1, p2, p3], 'DESC')[1] - list_sort([p0, p1, p2, p3], 'DESC')[2]) * 2)
    AS certainty"""),
    ("model", f"""CAST(CASE WHEN p0 = base_confidence THEN 0 WHEN p1 = base_confidence THEN 1
            WHEN p2 = base_confidence THEN 2 ELSE 3 END AS INTEGER) AS model_class"""),
    ("gaps", f"""abs((g_ph + {G_TDS_OF_TURB} + g_tu) / 3e0 - model_class) AS _gap,
  abs(rule_class - model_class) <= 1 AS _near,
  (tds <= 200 AND turbidity <= 1 AND ph BETWEEN 7.0 AND 7.5 AND model_class = 3)
    OR ((tds >= 1200 OR turbidity >= 15 OR ph <= 5.5 OR ph >= 9.5) AND model_class = 0)
    OR (tds >= 1000 AND turbidity >= 8 AND model_class <= 1) AS clear_case"""),
    ("consistency", f"""greatest(0e0, CASE WHEN _gap < 0.5e0 THEN least(1e0, (1 - _gap / 3e0) + 0.2e0)
                     ELSE 1 - _gap / 3e0 END) AS consistency"""),
    ("standards", f"""base_confidence + consistency > 0 AND consistency > base_confidence * 1.5e0 AS _rule_wins,
  CASE WHEN _near THEN
         CASE WHEN rule_class = model_class
              THEN least(0.95e0, least(0.95e0, base_confidence + (0.15e0 + consistency * 0.25e0)) + 0.1e0)
              ELSE least(0.95e0, base_confidence + (0.15e0 + consistency * 0.25e0)) END
       WHEN base_confidence + consistency > 0 THEN
         CASE WHEN consistency > base_confidence * 1.5e0 THEN least(0.85e0, 0.6e0 + consistency * 0.25e0)
              ELSE least(0.75e0, base_confidence + 0.1e0) END
       ELSE base_confidence END AS standards_confidence"""),
    ("boost", f"""CAST(CASE WHEN _near THEN model_class WHEN _rule_wins THEN rule_class ELSE model_class END
       AS INTEGER) AS quality_class,
  least(0.98e0, standards_confidence
    * (CASE WHEN f_avg >= 3.5e0 THEN 1.35e0 WHEN f_avg >= 2.5e0 THEN 1.25e0 ELSE 1e0 END)
    * (CASE WHEN agreement > 0.8e0 THEN 1.2e0 ELSE 1e0 END)
    * (CASE WHEN abs(standards_class - model_class) <= 0.5e0 THEN 1.15e0 ELSE 1e0 END)
    * (CASE WHEN synergy > 0.7e0 THEN 1.1e0 ELSE 1e0 END)
    * (CASE WHEN certainty > 0.6e0 THEN 1 + (certainty - 0.6e0) * 0.3e0 ELSE 1e0 END)
    * (CASE WHEN clear_case THEN 1.12e0 ELSE 1e0 END)) AS confidence"""),
    ("final", f"""{LABEL_CASE.format(c='quality_class')} AS quality_label,
  confidence > base_confidence AS enhancement_applied,
  CASE WHEN confidence < 0.45e0 THEN 'Low confidence prediction. Consider additional testing.'
       WHEN quality_class = 3 THEN 'Excellent water quality. Safe for consumption.'
       WHEN quality_class = 2 THEN 'Good water quality. Generally safe for consumption.'
       WHEN quality_class = 1 THEN 'Acceptable water quality. Monitor regularly and consider treatment.'
       ELSE 'Poor water quality. Treatment required before consumption.' END AS recommendation"""),
]


# The distances of the second stand-in model: mirrored class, low sharpness.
DISTANCES_DISAGREE = """exp(-0.1e0 * abs((9e0 - (g_ph + g_tds + g_tu)) / 3e0 - 0)) AS e0_,
  exp(-0.1e0 * abs((9e0 - (g_ph + g_tds + g_tu)) / 3e0 - 1)) AS e1_,
  exp(-0.1e0 * abs((9e0 - (g_ph + g_tds + g_tu)) / 3e0 - 2)) AS e2_,
  exp(-0.1e0 * abs((9e0 - (g_ph + g_tds + g_tu)) / 3e0 - 3)) AS e3_,
  sqrt(((f_ph - f_avg) * (f_ph - f_avg) + (f_tds - f_avg) * (f_tds - f_avg)
        + (f_tu - f_avg) * (f_tu - f_avg)) / 3e0) AS f_sd"""


def chain_ctes(source: str, name: str = "chain", more: str = "", steps=CHAIN_STEPS) -> str:
    """The chain over ``source`` as chained CTEs that end in ``name``;
    ``more`` are further columns of the last one."""
    ctes, at = [], source
    for step, columns in steps:
        ctes.append(f"{name}_{step} AS MATERIALIZED (SELECT *, {columns} FROM {at})")
        at = f"{name}_{step}"
    ctes.append(f"{name} AS MATERIALIZED (SELECT *{more} FROM {at})")
    return ",\n".join(ctes)


CHAIN = with_(READINGS, VALID, chain_ctes("valid"))
CHAIN_DISAGREE = with_(READINGS, VALID, chain_ctes("valid", steps=[
    (step, DISTANCES_DISAGREE if step == "distances" else columns) for step, columns in CHAIN_STEPS]))
CHAIN_ALL = with_(READINGS, chain_ctes("readings"))


def pct_sql(x: str, digits: int) -> str:
    return f"printf('%.{digits}f%%', {py_round_sql(f'({x}) * 100e0', digits)})"


def scored(spark, sf_dir, source="events"):
    return score(readings(spark, sf_dir, source))


# -- registered queries -------------------------------------------------------

@query("e01_argmax_confidence", CHAIN + """
SELECT reading_id, model_class, round(base_confidence, 6) AS base_confidence,
       round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM chain""")
def e01_argmax_confidence(spark, sf_dir):
    """Argmax class (first max wins) and its probability."""
    df = scored(spark, sf_dir)
    return df.select("reading_id", "model_class", r("base_confidence").alias("base_confidence"),
                     *[r(F.col("probability")[i]).alias(f"p{i}") for i in range(4)])


@query("e02_rule_class", CHAIN + "SELECT reading_id, rule_class FROM chain")
def e02_rule_class(spark, sf_dir):
    """Rule class int(round(grade sum / 3))."""
    return valid(spark, sf_dir).select("reading_id", rule_class().alias("rule_class"))


@query("e03_parameter_consistency", CHAIN + """
SELECT reading_id, round(consistency, 6) AS consistency FROM chain""")
def e03_parameter_consistency(spark, sf_dir):
    """Parameter consistency against the model class (quirk Q-1 kept)."""
    df = scored(spark, sf_dir)
    return df.select("reading_id", r(parameter_consistency("tds", "turbidity", "ph",
                                                           "model_class")).alias("consistency"))


@query("e04_standards_enhance", CHAIN + """
SELECT reading_id, round(standards_confidence, 6) AS standards_confidence, quality_class FROM chain""")
def e04_standards_enhance(spark, sf_dir):
    """Standards-based enhancement -> (confidence, adjusted class)."""
    df = scored(spark, sf_dir)
    return df.select("reading_id", r("standards_confidence").alias("standards_confidence"),
                     "quality_class")


@query("e04_standards_enhance_disagreeing", CHAIN_DISAGREE + """
SELECT reading_id, model_class, rule_class, round(standards_confidence, 6) AS standards_confidence, quality_class
FROM chain""")
def e04_standards_enhance_disagreeing(spark, sf_dir):
    """E4 on the stand-in model that disagrees with the rules: its far
    branches, the one where the rule class wins among them."""
    df = score(readings(spark, sf_dir), disagreeing_model)
    return df.select("reading_id", "model_class", rule_class("tds", "turbidity", "ph").alias("rule_class"),
                     r("standards_confidence").alias("standards_confidence"), "quality_class")


@query("p06_low_confidence_disagreeing", CHAIN_DISAGREE + """
SELECT reading_id, round(confidence, 6) AS confidence FROM chain WHERE confidence < 0.7e0""")
def p06_low_confidence_disagreeing(spark, sf_dir):
    """P6 on the stand-in model that disagrees with the rules."""
    return score(readings(spark, sf_dir), disagreeing_model).where(F.col("confidence") < 0.7).select(
        "reading_id", r("confidence").alias("confidence"))


@query("e05_booster_components", CHAIN + """
SELECT reading_id, f_ph AS ph_fine, f_tds AS tds_fine, f_tu AS turbidity_fine,
       round(agreement, 6) AS agreement, round(certainty, 6) AS certainty,
       round(standards_class, 6) AS standards_class, round(synergy, 6) AS synergy, clear_case
FROM chain""")
def e05_booster_components(spark, sf_dir):
    """Fine grades, grade agreement, certainty, standards class,
    synergy and clear-case flag."""
    df = scored(spark, sf_dir)
    g1, g2, g3 = ph_grade_fine(), tds_grade_fine(), turbidity_grade_fine()
    return df.select("reading_id", g1.alias("ph_fine"), g2.alias("tds_fine"),
                     g3.alias("turbidity_fine"), r(grade_agreement(g1, g2, g3)).alias("agreement"),
                     r(certainty("probability")).alias("certainty"),
                     r(standards_class(g1, g2, g3)).alias("standards_class"),
                     r(synergy(g1, g2, g3)).alias("synergy"),
                     clear_case("tds", "turbidity", "ph", "model_class").alias("clear_case"))


@query("e11_booster", CHAIN + "SELECT reading_id, round(confidence, 6) AS confidence FROM chain")
def e11_booster(spark, sf_dir):
    """Boosted confidence (capped at 0.98)."""
    return scored(spark, sf_dir).select("reading_id", r("confidence").alias("confidence"))


@query("e12_final_prediction", CHAIN + """
SELECT reading_id, quality_class, quality_label, round(confidence, 6) AS confidence,
       enhancement_applied, recommendation FROM chain""")
def e12_final_prediction(spark, sf_dir):
    """E12 + C7: final class, label, confidence, enhancement flag and
    recommendation."""
    return scored(spark, sf_dir).select("reading_id", "quality_class", "quality_label",
                                        r("confidence").alias("confidence"),
                                        "enhancement_applied", "recommendation")


@query("c07_recommendation_notebook", CHAIN + """
SELECT reading_id, CASE WHEN confidence < 0.7e0 THEN 'Low confidence prediction. Consider additional testing.'
       WHEN quality_class = 3 THEN 'Excellent water quality. Safe for consumption.'
       WHEN quality_class = 2 THEN 'Good water quality. Generally safe for consumption.'
       WHEN quality_class = 1 THEN 'Acceptable water quality. Monitor regularly and consider treatment.'
       ELSE 'Poor water quality. Treatment required before consumption.' END AS recommendation
FROM chain""")
def c07_recommendation_notebook(spark, sf_dir):
    """C7, notebook variant: low-confidence threshold 0.7."""
    df = score(readings(spark, sf_dir), rec_threshold=0.7)
    return df.select("reading_id", "recommendation")


@query("p13_prediction_record", CHAIN_ALL + f"""
SELECT reading_id,
  CASE WHEN NOT (ph BETWEEN 4.0 AND 12.0) THEN 'pH value ' || CAST(ph AS VARCHAR) || ' is outside valid range (4.0-12.0)'
       WHEN NOT (tds BETWEEN 0 AND 5000) THEN 'TDS value ' || CAST(tds AS VARCHAR) || ' is outside valid range (0-5000 mg/L)'
       WHEN NOT (turbidity BETWEEN 0 AND 100) THEN 'Turbidity value ' || CAST(turbidity AS VARCHAR) || ' is outside valid range (0-100 NTU)'
  END AS error,
  CASE WHEN {VALID_WHERE} THEN tds END AS input_tds,
  CASE WHEN {VALID_WHERE} THEN CAST(quality_class AS DOUBLE) END AS quality_class,
  CASE WHEN {VALID_WHERE} THEN quality_label END AS quality_label,
  CASE WHEN {VALID_WHERE} THEN round(confidence, 6) END AS confidence,
  CASE WHEN {VALID_WHERE} THEN round(p0, 6) END AS prob_poor,
  CASE WHEN {VALID_WHERE} THEN round(p3, 6) END AS prob_excellent,
  CASE WHEN {VALID_WHERE} THEN recommendation END AS recommendation,
  CASE WHEN {VALID_WHERE} THEN CAST(enhancement_applied AS VARCHAR) END AS enhancement_applied
FROM chain""")
def p13_prediction_record(spark, sf_dir):
    """Nested prediction record for every reading (invalid ones carry
    only ``error``), flattened for comparison."""
    rec = prediction_record(rule_model(readings(spark, sf_dir)))
    return rec.select("reading_id", "error", F.col("input.tds").alias("input_tds"),
                      F.col("prediction.quality_class").cast("double").alias("quality_class"),
                      F.col("prediction.quality_label").alias("quality_label"),
                      r("prediction.confidence").alias("confidence"),
                      r(F.col("probabilities")["Poor"]).alias("prob_poor"),
                      r(F.col("probabilities")["Excellent"]).alias("prob_excellent"),
                      "recommendation",
                      F.col("enhancement_applied").cast("string").alias("enhancement_applied"))


REPORT_SQL = f"""'
=== WATER QUALITY ANALYSIS REPORT ===

Sensor Readings:
- TDS (Total Dissolved Solids): ' || CAST(tds AS VARCHAR) || ' mg/L
- Turbidity: ' || CAST(turbidity AS VARCHAR) || ' NTU
- pH Level: ' || CAST(ph AS VARCHAR) || '

Prediction Results:
- Quality Classification: ' || quality_label || '
- Confidence: ' || {pct_sql('confidence', 2)} || '

Detailed Probabilities:
- Poor: ' || {pct_sql('p0', 2)} || '
- Acceptable: ' || {pct_sql('p1', 2)} || '
- Good: ' || {pct_sql('p2', 2)} || '
- Excellent: ' || {pct_sql('p3', 2)} || '

Recommendation: ' || recommendation || '

Parameter Analysis:
' || (CASE WHEN ph BETWEEN 7.0 AND 7.5 THEN '- pH: Optimal range (7.0-7.5)'
           WHEN ph BETWEEN 6.5 AND 8.5 THEN '- pH: Acceptable range (6.5-8.5)'
           ELSE '- pH: Outside acceptable range (6.5-8.5) - requires attention' END) || chr(10)
  || (CASE WHEN tds <= 300 THEN '- TDS: Excellent (<300 mg/L)' WHEN tds <= 600 THEN '- TDS: Good (300-600 mg/L)'
           WHEN tds <= 900 THEN '- TDS: Acceptable (600-900 mg/L)'
           ELSE '- TDS: Poor (>900 mg/L) - treatment recommended' END) || chr(10)
  || (CASE WHEN turbidity <= 1 THEN '- Turbidity: Excellent (<1 NTU)' WHEN turbidity <= 4 THEN '- Turbidity: Good (1-4 NTU)'
           WHEN turbidity <= 10 THEN '- Turbidity: Acceptable (4-10 NTU)'
           ELSE '- Turbidity: Poor (>10 NTU) - filtration needed' END) || chr(10)"""


@query("c11_text_report", CHAIN + f"SELECT reading_id, {REPORT_SQL} AS report FROM chain")
def c11_text_report(spark, sf_dir):
    """C11: the full per-reading text report."""
    df = scored(spark, sf_dir)
    return df.select("reading_id", text.text_report("tds", "turbidity", "ph", "quality_label",
                                                    "confidence", "probability",
                                                    "recommendation").alias("report"))


ICON_SQL = ("CASE quality_label WHEN 'Excellent' THEN '🟢' WHEN 'Good' THEN '🔵' "
            "WHEN 'Acceptable' THEN '🟡' WHEN 'Poor' THEN '🔴' ELSE '⚪' END")


@query("c12_display_text", CHAIN + f"""
SELECT reading_id, '
' || {ICON_SQL} || ' Water Quality: ' || quality_label || '
📊 Confidence: ' || {pct_sql('confidence', 1)} || '
💧 Recommendation: ' || recommendation || '

Sensor Readings:
- TDS: ' || CAST(tds AS VARCHAR) || ' mg/L
- Turbidity: ' || CAST(turbidity AS VARCHAR) || ' NTU  ' || chr(10) || '- pH: ' || CAST(ph AS VARCHAR) || '
' AS display FROM chain""")
def c12_display_text(spark, sf_dir):
    """Short display text with the class icon."""
    df = scored(spark, sf_dir)
    return df.select("reading_id", text.display_text("tds", "turbidity", "ph", "quality_label",
                                                     "confidence", "recommendation")
                     .alias("display"))


I8 = "        "


@query("c15_prompt_text", CHAIN + f"""
SELECT reading_id, '
{I8}You are a water quality expert. Based on the following scientific water quality analysis results, provide a clear, human-readable summary for general consumers.

{I8}**Sensor Measurements:**
{I8}- TDS (Total Dissolved Solids): ' || CAST(tds AS VARCHAR) || ' mg/L
{I8}- Turbidity: ' || CAST(turbidity AS VARCHAR) || ' NTU
{I8}- pH Level: ' || CAST(ph AS VARCHAR) || '

{I8}**AI Model Prediction:**
{I8}- Quality Classification: ' || quality_label || '
{I8}- Confidence Level: ' || {pct_sql('confidence', 1)} || '

{I8}**Detailed Probabilities:**
{I8}- Poor Quality: ' || {pct_sql('p0', 1)} || '
{I8}- Acceptable Quality: ' || {pct_sql('p1', 1)} || '
{I8}- Good Quality: ' || {pct_sql('p2', 1)} || '
{I8}- Excellent Quality: ' || {pct_sql('p3', 1)} || '

{I8}**Technical Recommendation:** ' || recommendation || '

{I8}Please provide a 2-3 sentence summary that:
{I8}1. Explains what these results mean in simple terms
{I8}2. Highlights any concerning parameters
{I8}3. Gives practical advice for the consumer
{I8}4. Uses everyday language (avoid technical jargon)

{I8}Keep it concise, informative, and actionable for someone without technical background. Describe it in Indonesia language
{I8}' AS prompt FROM chain""")
def c15_prompt_text(spark, sf_dir):
    """The summary-prompt text (the external model call is not built)."""
    df = scored(spark, sf_dir)
    return df.select("reading_id", text.prompt_text("tds", "turbidity", "ph", "quality_label",
                                                    "confidence", "probability",
                                                    "recommendation").alias("prompt"))


@query("c13_analysis_record", with_(READINGS, chain_ctes("readings")) + f"""
, v AS (SELECT *, concat_ws('; ',
    CASE WHEN ph < 4.0 OR ph > 12.0 THEN 'pH ' || CAST(ph AS VARCHAR) || ' is outside realistic range (4.0-12.0)' END,
    CASE WHEN tds < 0 OR tds > 5000 THEN 'TDS ' || CAST(tds AS VARCHAR) || ' mg/L is outside realistic range (0-5000)' END,
    CASE WHEN turbidity < 0 OR turbidity > 100 THEN 'Turbidity ' || CAST(turbidity AS VARCHAR) || ' NTU is outside realistic range (0-100)' END) AS _err
  FROM chain)
SELECT reading_id, tds, turbidity, ph,
  CASE WHEN _err <> '' THEN _err END AS error,
  CASE WHEN _err = '' THEN CAST(quality_class AS DOUBLE) END AS quality_class,
  CASE WHEN _err = '' THEN round(confidence, 6) END AS confidence,
  CASE WHEN _err = '' THEN round({SIMPLE_WQI_SQL}, 6) END AS water_quality_index,
  CASE WHEN _err = '' THEN {py_round_sql(SERVICE_WQI_SQL, 2)} END AS service_wqi,
  CASE WHEN _err = '' THEN {ASSESS_SQL.format(c='quality_class', w=SERVICE_WQI_SQL)} END AS overall_assessment,
  CASE WHEN _err = '' THEN CASE WHEN ph < 6.5 THEN 'Acidic (' || CAST(ph AS VARCHAR) || ') - may cause corrosion'
       WHEN ph > 8.5 THEN 'Alkaline (' || CAST(ph AS VARCHAR) || ') - may cause scaling'
       ELSE 'Within acceptable range (' || CAST(ph AS VARCHAR) || ')' END END AS ph_analysis
FROM v""")
def c13_analysis_record(spark, sf_dir):
    """Validate -> predict -> simple WQI -> parameter analysis, plus the
    service WQI (2 dp) and overall assessment."""
    df = analysis_record(readings(spark, sf_dir))
    return df.select("reading_id", "tds", "turbidity", "ph", "error",
                     F.col("quality_class").cast("double").alias("quality_class"),
                     r("confidence").alias("confidence"),
                     r("water_quality_index").alias("water_quality_index"), "service_wqi",
                     "overall_assessment", F.col("parameter_analysis")["ph"].alias("ph_analysis"))


@query("c16_summary_table", CHAIN + f"""
SELECT reading_id, site AS description, tds, turbidity, ph, quality_label AS predicted_quality,
       {pct_sql('confidence', 1)} AS confidence_text FROM chain""")
def c16_summary_table(spark, sf_dir):
    """Prediction summary table (description = site)."""
    df = scored(spark, sf_dir)
    return df.select("reading_id", F.col("site").alias("description"), "tds", "turbidity", "ph",
                     F.col("quality_label").alias("predicted_quality"),
                     pct("confidence", 1).alias("confidence_text"))


@query("c17_batch_result_table", CHAIN + f"""
SELECT row_number() OVER (ORDER BY reading_id) AS "Sample", tds AS "TDS", turbidity AS "Turbidity",
       ph AS "pH", quality_label AS "Quality", round(confidence, 6) AS "Confidence",
       round({SIMPLE_WQI_SQL}, 6) AS "WQI" FROM chain""")
def c17_batch_result_table(spark, sf_dir):
    """C17: batch result table; failing rows dropped, 1-based ``Sample``."""
    df = with_row_index(scored(spark, sf_dir), "reading_id", "Sample", 1)
    return df.select("Sample", F.col("tds").alias("TDS"), F.col("turbidity").alias("Turbidity"),
                     F.col("ph").alias("pH"), F.col("quality_label").alias("Quality"),
                     r("confidence").alias("Confidence"), r(wqi_simple()).alias("WQI"))


@query("c17_batch_totals", CHAIN + """
, labels AS (SELECT * FROM (VALUES ('Poor'), ('Acceptable'), ('Good'), ('Excellent')) t(quality_label))
, counts AS (SELECT quality_label, count(*) AS n FROM chain GROUP BY quality_label)
SELECT l.quality_label, coalesce(c.n, 0) AS n,
       round(coalesce(c.n, 0) * 100e0 / (SELECT count(*) FROM chain), 6) AS pct
FROM labels l LEFT JOIN counts c USING (quality_label)""")
def c17_batch_totals(spark, sf_dir):
    """C17 totals: count and % for all four predicted labels."""
    return (profile.class_share_all(scored(spark, sf_dir))
            .select("quality_label", "n", r("pct").alias("pct")))


@query("m07_quality_report", CHAIN + """
SELECT quality_label, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct,
       round(avg(confidence), 6) AS mean_confidence, round(avg(tds), 4) AS avg_tds,
       round(avg(turbidity), 4) AS avg_turbidity, round(avg(ph), 4) AS avg_ph,
       count_if(recommendation LIKE 'Low confidence%') AS low_confidence
FROM chain GROUP BY quality_label""")
def m07_quality_report(spark, sf_dir):
    """M7 flagship: score every valid reading (stand-in model + confidence
    chain) and report per predicted class: count, share, mean confidence,
    mean sensors and low-confidence count."""
    df = scored(spark, sf_dir)
    agg = df.groupBy("quality_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.avg("tds").alias("avg_tds"), F.avg("turbidity").alias("avg_turbidity"),
        F.avg("ph").alias("avg_ph"),
        F.count_if(F.col("recommendation").startswith("Low confidence")).alias("low_confidence"))
    from pyspark.sql import Window
    return agg.select("quality_label", "n",
                      r(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"),
                      r("mean_confidence").alias("mean_confidence"),
                      r("avg_tds", 4).alias("avg_tds"), r("avg_turbidity", 4).alias("avg_turbidity"),
                      r("avg_ph", 4).alias("avg_ph"), "low_confidence")


CHAIN_LINEITEM = with_(READINGS_LINEITEM, VALID, chain_ctes("valid"))


@query("m07_quality_report_lineitem", CHAIN_LINEITEM + """
SELECT quality_label, count(*) AS n, round(avg(confidence), 6) AS mean_confidence,
       round(avg(tds), 4) AS avg_tds, round(avg(turbidity), 4) AS avg_turbidity,
       round(avg(ph), 4) AS avg_ph
FROM chain GROUP BY quality_label""")
def m07_quality_report_lineitem(spark, sf_dir):
    """M7 flagship over the lineitem readings (the volume table)."""
    df = scored(spark, sf_dir, "lineitem")
    agg = df.groupBy("quality_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.avg("tds").alias("avg_tds"), F.avg("turbidity").alias("avg_turbidity"),
        F.avg("ph").alias("avg_ph"))
    return agg.select("quality_label", "n", r("mean_confidence").alias("mean_confidence"),
                      r("avg_tds", 4).alias("avg_tds"), r("avg_turbidity", 4).alias("avg_turbidity"),
                      r("avg_ph", 4).alias("avg_ph"))
