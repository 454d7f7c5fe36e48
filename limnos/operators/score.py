"""Labelling and scoring (C2, P7, P13, E1-E12, M7 wiring, C13, C17).

A "model" here is anything that appends an ``array<double>`` probability
column (one entry per class): a fitted Spark ML ``PipelineModel`` via
``operators.model.model_probabilities`` or the rule stand-in below.  The
confidence chain that follows is built-in column arithmetic in a few
projections; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import py_round
from ..functions.arrays import argmax, rule_probabilities, top_prob
from ..functions.confidence import boost, standards_enhance
from ..functions.grades import grade_sum, quality_class
from ..functions.indices import overall_assessment, wqi_service, wqi_simple
from ..functions.text import parameter_analysis, recommendation
from ..schema import QUALITY_LABELS, label_of
from .validate import first_error, is_valid, validation_errors, validation_warnings


def label_readings(df: DataFrame) -> DataFrame:
    """C2 + P7: ``quality`` (0-3) and ``quality_label``."""
    return (df.withColumn("quality", quality_class())
            .withColumn("quality_label", label_of(F.col("quality"))))


def rule_model(df: DataFrame, sharpness: float = 2.0) -> DataFrame:
    """Stand-in model: probabilities from the grade sum (see
    ``functions.arrays.rule_probabilities``)."""
    return df.withColumn("probability", rule_probabilities(grade_sum(), sharpness))


def disagreeing_model(df: DataFrame, sharpness: float = 0.1) -> DataFrame:
    """Second stand-in model, unsure and mirrored: it calls good readings bad
    and bad ones good, so that the standards step meets disagreement of two
    classes and more, and low confidence occurs."""
    return df.withColumn("probability", rule_probabilities(9.0 - grade_sum(), sharpness))


def enhance(df: DataFrame, probability: str = "probability",
            rec_threshold: float = 0.45) -> DataFrame:
    """E1-E12 + C7 on a frame with readings and a probability row."""
    staged = (df.withColumn("model_class", argmax(probability))
              .withColumn("base_confidence", top_prob(probability)))
    staged = staged.withColumn(
        "_enh", standards_enhance("tds", "turbidity", "ph", "model_class", "base_confidence"))
    staged = (staged.withColumn("standards_confidence", F.col("_enh.confidence"))
              .withColumn("quality_class", F.col("_enh.quality_class")).drop("_enh"))
    staged = staged.withColumn(
        "confidence", boost("tds", "turbidity", "ph", "model_class", "standards_confidence",
                            probability))
    return (staged.withColumn("quality_label", label_of(F.col("quality_class")))
            .withColumn("enhancement_applied", F.col("confidence") > F.col("base_confidence"))
            .withColumn("recommendation",
                        recommendation("quality_class", "confidence", rec_threshold)))


def probabilities_map(probability: str = "probability"):
    return F.map_from_arrays(F.array(*[F.lit(QUALITY_LABELS[i]) for i in range(4)]),
                             F.col(probability))


def prediction_record(df: DataFrame, probability: str = "probability") -> DataFrame:
    """The nested prediction record; invalid rows carry only ``error``."""
    scored = enhance(df.withColumn("error", first_error()), probability)
    ok = F.col("error").isNull()
    return scored.select(
        *[c for c in ("reading_id",) if c in df.columns],
        F.when(ok, F.struct("tds", "turbidity", "ph")).alias("input"),
        F.when(ok, F.struct(F.col("quality_class"), F.col("quality_label"),
                            F.col("confidence"))).alias("prediction"),
        F.when(ok, probabilities_map(probability)).alias("probabilities"),
        F.when(ok, F.col("recommendation")).alias("recommendation"),
        F.when(ok, F.col("enhancement_applied")).alias("enhancement_applied"),
        F.col("error"))


def score(df: DataFrame, model=rule_model, rec_threshold: float = 0.45) -> DataFrame:
    """M7: valid rows -> model probabilities -> enhanced prediction."""
    valid = df.where(is_valid())
    return enhance(model(valid), rec_threshold=rec_threshold)


def analysis_record(df: DataFrame, model=rule_model) -> DataFrame:
    """Validation (errors joined by '; ') -> prediction -> simple WQI ->
    parameter analysis, plus the service form (service WQI rounded to 2 dp
    and the overall assessment)."""
    v = (df.withColumn("_errors", validation_errors())
         .withColumn("validation_warnings", validation_warnings()))
    ok = F.size("_errors") == 0
    scored = enhance(model(v))
    return scored.select(
        *[c for c in ("reading_id",) if c in df.columns], "tds", "turbidity", "ph",
        F.when(~ok, F.array_join("_errors", "; ")).alias("error"),
        F.when(ok, F.col("quality_class")).alias("quality_class"),
        F.when(ok, F.col("confidence")).alias("confidence"),
        F.when(ok, wqi_simple()).alias("water_quality_index"),
        F.when(ok, F.col("validation_warnings")).alias("validation_warnings"),
        F.when(ok, parameter_analysis()).alias("parameter_analysis"),
        F.when(ok, py_round(wqi_service(), 2)).alias("service_wqi"),
        F.when(ok, overall_assessment(F.col("quality_class"), wqi_service()))
        .alias("overall_assessment"))
