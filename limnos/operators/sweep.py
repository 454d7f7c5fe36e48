"""One-feature sweep (M23) and the guidelines dimension (C14).

Both take fixed, small inputs (a 100-point grid; a fixed text table), so
they are library operators and unit-tested, not registered table queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sweep ranges and the held values of the other two sensors.
SWEEP_RANGES = {"tds": (100.0, 1500.0), "turbidity": (0.1, 20.0), "ph": (5.0, 9.0)}
SWEEP_DEFAULTS = {"tds": 300.0, "turbidity": 2.0, "ph": 7.0}


def feature_sweep(spark: SparkSession, feature: str, points: int = 100, model=None) -> DataFrame:
    """Vary one sensor over ``points`` evenly spaced values (numpy
    ``linspace``), hold the others at the defaults, score every point."""
    from .score import rule_model, score

    lo, hi = SWEEP_RANGES[feature]
    step = (hi - lo) / (points - 1)
    grid = spark.range(points).select(
        F.col("id").alias("reading_id"),
        *[(F.lit(lo) + F.col("id") * step).alias(c) if c == feature else F.lit(v).alias(c)
          for c, v in SWEEP_DEFAULTS.items()])
    grid = grid.withColumn(feature, F.when(F.col("reading_id") == points - 1, F.lit(hi))
                           .otherwise(F.col(feature)))
    return score(grid, model or rule_model).select(
        "reading_id", feature, "quality_class", "quality_label", "confidence", "probability")


# Published guideline text.
GUIDELINES = [
    ("ph", "optimal", "7.0 - 7.5"),
    ("ph", "acceptable", "6.5 - 8.5 (WHO/EPA standard)"),
    ("ph", "note", "Outside range requires treatment"),
    ("tds", "excellent", "< 300 mg/L"),
    ("tds", "good", "300 - 600 mg/L"),
    ("tds", "acceptable", "600 - 900 mg/L"),
    ("tds", "poor", "> 900 mg/L"),
    ("turbidity", "excellent", "< 1 NTU"),
    ("turbidity", "good", "1 - 4 NTU"),
    ("turbidity", "acceptable", "4 - 10 NTU"),
    ("turbidity", "poor", "> 10 NTU"),
]


def guidelines(spark: SparkSession) -> DataFrame:
    """C14: the water-quality guidelines as a small dimension frame."""
    return spark.createDataFrame(GUIDELINES, "parameter string, grade string, range string")
