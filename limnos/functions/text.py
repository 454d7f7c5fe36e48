"""Text projections: recommendations, parameter analysis, reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col, pct, pystr
from ..schema import QUALITY_LABELS

# Recommendation texts (model predictor and notebook variant).
REC_LOW = "Low confidence prediction. Consider additional testing."
REC_BY_CLASS = {
    3: "Excellent water quality. Safe for consumption.",
    2: "Good water quality. Generally safe for consumption.",
    1: "Acceptable water quality. Monitor regularly and consider treatment.",
    0: "Poor water quality. Treatment required before consumption.",
}
# Label icons used by the short display text.
LABEL_ICON = {"Excellent": "🟢", "Good": "🔵", "Acceptable": "🟡", "Poor": "🔴"}


def recommendation(quality_class, confidence, low_threshold: float = 0.45) -> Column:
    c, conf = col(quality_class), col(confidence)
    return (F.when(conf < low_threshold, F.lit(REC_LOW))
            .when(c == 3, F.lit(REC_BY_CLASS[3]))
            .when(c == 2, F.lit(REC_BY_CLASS[2]))
            .when(c == 1, F.lit(REC_BY_CLASS[1]))
            .otherwise(F.lit(REC_BY_CLASS[0])))


def ph_analysis(ph="ph") -> Column:
    p = col(ph)
    s = pystr(p)
    return (F.when(p < 6.5, F.concat(F.lit("Acidic ("), s, F.lit(") - may cause corrosion")))
            .when(p > 8.5, F.concat(F.lit("Alkaline ("), s, F.lit(") - may cause scaling")))
            .otherwise(F.concat(F.lit("Within acceptable range ("), s, F.lit(")"))))


def tds_analysis(tds="tds") -> Column:
    t = col(tds)
    s = pystr(t)
    return (F.when(t > 1000, F.concat(F.lit("High TDS ("), s, F.lit(" mg/L) - may affect taste")))
            .when(t < 50, F.concat(F.lit("Very low TDS ("), s, F.lit(" mg/L) - may lack minerals")))
            .otherwise(F.concat(F.lit("Acceptable TDS level ("), s, F.lit(" mg/L)"))))


def turbidity_analysis(turbidity="turbidity") -> Column:
    u = col(turbidity)
    s = pystr(u)
    return (F.when(u > 4, F.concat(F.lit("High turbidity ("), s,
                                   F.lit(" NTU) - filtration recommended")))
            .otherwise(F.concat(F.lit("Acceptable clarity ("), s, F.lit(" NTU)"))))


def parameter_analysis(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """map<string,string> keyed ph / tds / turbidity."""
    return F.create_map(F.lit("ph"), ph_analysis(ph), F.lit("tds"), tds_analysis(tds),
                        F.lit("turbidity"), turbidity_analysis(turbidity))


def ph_status(ph="ph") -> Column:
    p = col(ph)
    return (F.when(p.between(7.0, 7.5), F.lit("✅ Optimal"))
            .when(p.between(6.5, 8.5), F.lit("✅ Good"))
            .otherwise(F.lit("⚠️ Needs attention")))


def _four_level_status(x: Column, a: float, b: float, c: float) -> Column:
    return (F.when(x <= a, F.lit("✅ Excellent")).when(x <= b, F.lit("✅ Good"))
            .when(x <= c, F.lit("⚠️ Acceptable")).otherwise(F.lit("❌ High")))


def tds_status(tds="tds") -> Column:
    return _four_level_status(col(tds), 300, 600, 900)


def turbidity_status(turbidity="turbidity") -> Column:
    return _four_level_status(col(turbidity), 1, 4, 10)


def graded_lines(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """The report's 'Parameter Analysis' block (three lines, each ending in
    a newline)."""
    t, u, p = col(tds), col(turbidity), col(ph)
    ph_l = (F.when(p.between(7.0, 7.5), F.lit("- pH: Optimal range (7.0-7.5)\n"))
            .when(p.between(6.5, 8.5), F.lit("- pH: Acceptable range (6.5-8.5)\n"))
            .otherwise(F.lit("- pH: Outside acceptable range (6.5-8.5) - requires attention\n")))
    tds_l = (F.when(t <= 300, F.lit("- TDS: Excellent (<300 mg/L)\n"))
             .when(t <= 600, F.lit("- TDS: Good (300-600 mg/L)\n"))
             .when(t <= 900, F.lit("- TDS: Acceptable (600-900 mg/L)\n"))
             .otherwise(F.lit("- TDS: Poor (>900 mg/L) - treatment recommended\n")))
    tu_l = (F.when(u <= 1, F.lit("- Turbidity: Excellent (<1 NTU)\n"))
            .when(u <= 4, F.lit("- Turbidity: Good (1-4 NTU)\n"))
            .when(u <= 10, F.lit("- Turbidity: Acceptable (4-10 NTU)\n"))
            .otherwise(F.lit("- Turbidity: Poor (>10 NTU) - filtration needed\n")))
    return F.concat(ph_l, tds_l, tu_l)


def text_report(tds, turbidity, ph, label, confidence, probability, rec) -> Column:
    """Full per-reading report; ``probability`` is array<double> by class."""
    probs = col(probability)
    prob_lines = F.concat(*[
        F.concat(F.lit(f"- {QUALITY_LABELS[i]}: "), pct(probs[i], 2), F.lit("\n"))
        for i in range(4)])
    return F.concat(
        F.lit("\n=== WATER QUALITY ANALYSIS REPORT ===\n\nSensor Readings:\n"
              "- TDS (Total Dissolved Solids): "), pystr(tds),
        F.lit(" mg/L\n- Turbidity: "), pystr(turbidity),
        F.lit(" NTU\n- pH Level: "), pystr(ph),
        F.lit("\n\nPrediction Results:\n- Quality Classification: "), col(label),
        F.lit("\n- Confidence: "), pct(confidence, 2),
        F.lit("\n\nDetailed Probabilities:\n"), prob_lines,
        F.lit("\nRecommendation: "), col(rec), F.lit("\n"),
        F.lit("\nParameter Analysis:\n"), graded_lines(tds, turbidity, ph))


def display_text(tds, turbidity, ph, label, confidence, rec) -> Column:
    """Short display text with the class icon."""
    icon = F.coalesce(F.create_map(*[x for k, v in LABEL_ICON.items()
                                     for x in (F.lit(k), F.lit(v))])[col(label)],
                      F.lit("⚪"))
    return F.concat(
        F.lit("\n"), icon, F.lit(" Water Quality: "), col(label),
        F.lit("\n📊 Confidence: "), pct(confidence, 1),
        F.lit("\n💧 Recommendation: "), col(rec),
        F.lit("\n\nSensor Readings:\n- TDS: "), pystr(tds),
        F.lit(" mg/L\n- Turbidity: "), pystr(turbidity),
        F.lit(" NTU  \n- pH: "), pystr(ph), F.lit("\n"))


def prompt_text(tds, turbidity, ph, label, confidence, probability, rec) -> Column:
    """The summary-prompt string (the external model call is not built)."""
    probs = col(probability)
    i = "        "
    return F.concat(
        F.lit(f"\n{i}You are a water quality expert. Based on the following scientific water "
              "quality analysis results, provide a clear, human-readable summary for general "
              f"consumers.\n\n{i}**Sensor Measurements:**\n{i}- TDS (Total Dissolved Solids): "),
        pystr(tds), F.lit(f" mg/L\n{i}- Turbidity: "), pystr(turbidity),
        F.lit(f" NTU\n{i}- pH Level: "), pystr(ph),
        F.lit(f"\n\n{i}**AI Model Prediction:**\n{i}- Quality Classification: "), col(label),
        F.lit(f"\n{i}- Confidence Level: "), pct(confidence, 1),
        F.lit(f"\n\n{i}**Detailed Probabilities:**\n{i}- Poor Quality: "), pct(probs[0], 1),
        F.lit(f"\n{i}- Acceptable Quality: "), pct(probs[1], 1),
        F.lit(f"\n{i}- Good Quality: "), pct(probs[2], 1),
        F.lit(f"\n{i}- Excellent Quality: "), pct(probs[3], 1),
        F.lit(f"\n\n{i}**Technical Recommendation:** "), col(rec),
        F.lit(f"\n\n{i}Please provide a 2-3 sentence summary that:\n"
              f"{i}1. Explains what these results mean in simple terms\n"
              f"{i}2. Highlights any concerning parameters\n"
              f"{i}3. Gives practical advice for the consumer\n"
              f"{i}4. Uses everyday language (avoid technical jargon)\n\n"
              f"{i}Keep it concise, informative, and actionable for someone without technical "
              f"background. Describe it in Indonesia language\n{i}"))
