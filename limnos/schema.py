"""Schemas, the class-label map and the agency standards dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READING = T.StructType([
    T.StructField("tds", T.DoubleType()),
    T.StructField("turbidity", T.DoubleType()),
    T.StructField("ph", T.DoubleType()),
])

LABELLED = T.StructType(READING.fields + [
    T.StructField("quality", T.IntegerType()),
    T.StructField("quality_label", T.StringType()),
])

STREAM_READING = T.StructType([
    T.StructField("reading_id", T.LongType()),
    T.StructField("sensor_id", T.LongType()),
    T.StructField("site", T.StringType()),
    T.StructField("ts", T.TimestampType()),
] + READING.fields)

BASE_FEATURES = ["tds", "turbidity", "ph"]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# Class id -> label, and the label order used for probability maps.
QUALITY_LABELS = {0: "Poor", 1: "Acceptable", 2: "Good", 3: "Excellent"}
# Agency thresholds: pH ranges are closed intervals (lo, hi); TDS and
# turbidity values are inclusive upper limits per grade.
AGENCY_STANDARDS = {
    "who": {
        "ph": {"excellent": (7.0, 7.5), "good": (6.5, 8.5), "acceptable": (6.0, 9.0)},
        "tds": {"excellent": 300, "good": 600, "acceptable": 900},
        "turbidity": {"excellent": 1, "good": 4, "acceptable": 10},
    },
    "epa": {
        "ph": {"excellent": (6.8, 7.2), "good": (6.5, 8.5), "acceptable": (6.0, 9.0)},
        "tds": {"excellent": 500, "good": 1000, "acceptable": 1500},
        "turbidity": {"excellent": 1, "good": 5, "acceptable": 15},
    },
    "canada": {
        "ph": {"excellent": (7.0, 8.0), "good": (6.5, 8.5), "acceptable": (6.0, 9.0)},
        "tds": {"excellent": 200, "good": 500, "acceptable": 1000},
        "turbidity": {"excellent": 2, "good": 8, "acceptable": 20},
    },
}
# ---------------------------------------------------------------------------

GRADE_ORDER = ["excellent", "good", "acceptable"]


def label_of(cls: Column) -> Column:
    """Class id -> label through a literal map (no join, stays in codegen)."""
    m = F.create_map(*[x for k, v in QUALITY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return m[cls]


def label_dim(spark: SparkSession) -> DataFrame:
    """The label map as a 4-row dimension (fixed size: safe to broadcast)."""
    return spark.createDataFrame(
        [(k, v) for k, v in QUALITY_LABELS.items()],
        "quality int, quality_label string")


def standards_bands(spark: SparkSession) -> DataFrame:
    """Agency standards as *disjoint* bands ``(agency, parameter, grade,
    rank, lo, hi, lo_closed, hi_closed)`` so a reading value matches at most
    one band per (agency, parameter); no band means grade ``poor``.

    Nested pH ranges become an inner band plus a lower and an upper ring;
    upper limits for TDS and turbidity become half-open intervals.  The table
    has a fixed size (3 agencies x <= 15 bands): broadcasting it is bounded.
    """
    rows = []
    inf = float("inf")
    for agency, params in AGENCY_STANDARDS.items():
        ph = params["ph"]
        inner = None
        for rank, g in enumerate(GRADE_ORDER):
            lo, hi = ph[g]
            if inner is None:
                rows.append((agency, "ph", g, rank, lo, hi, True, True))
            else:
                ilo, ihi = inner
                if lo < ilo:
                    rows.append((agency, "ph", g, rank, lo, ilo, True, False))
                if ihi < hi:
                    rows.append((agency, "ph", g, rank, ihi, hi, False, True))
            inner = (lo, hi)
        for p in ("tds", "turbidity"):
            prev = -inf
            for rank, g in enumerate(GRADE_ORDER):
                hi = float(params[p][g])
                rows.append((agency, p, g, rank, prev, hi, prev == -inf, True))
                prev = hi
    return spark.createDataFrame(
        rows,
        "agency string, parameter string, grade string, grade_rank int, "
        "lo double, hi double, lo_closed boolean, hi_closed boolean")


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Column-presence check that raises (uploaded-file validation)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
