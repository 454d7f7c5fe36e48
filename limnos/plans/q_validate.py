"""Validation and error routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import py_round
from ..functions.indices import wqi_service
from ..operators import validate as V
from ..sources.readings import readings
from . import query
from .q_scoring import SERVICE_WQI_SQL
from .sql import READINGS, py_round_sql, with_

RB = with_(READINGS)

FIRST_ERROR_SQL = """CASE
  WHEN NOT (ph BETWEEN 4.0 AND 12.0) THEN 'pH value ' || CAST(ph AS VARCHAR) || ' is outside valid range (4.0-12.0)'
  WHEN NOT (tds BETWEEN 0 AND 5000) THEN 'TDS value ' || CAST(tds AS VARCHAR) || ' is outside valid range (0-5000 mg/L)'
  WHEN NOT (turbidity BETWEEN 0 AND 100) THEN 'Turbidity value ' || CAST(turbidity AS VARCHAR) || ' is outside valid range (0-100 NTU)'
END"""

ERR_PH = "CASE WHEN ph < 4.0 OR ph > 12.0 THEN 'pH ' || CAST(ph AS VARCHAR) || ' is outside realistic range (4.0-12.0)' END"
ERR_TDS = "CASE WHEN tds < 0 OR tds > 5000 THEN 'TDS ' || CAST(tds AS VARCHAR) || ' mg/L is outside realistic range (0-5000)' END"
ERR_TU = ("CASE WHEN turbidity < 0 OR turbidity > 100 THEN 'Turbidity ' || CAST(turbidity AS VARCHAR)"
          " || ' NTU is outside realistic range (0-100)' END")
WARN_PH = ("CASE WHEN ph BETWEEN 4.0 AND 12.0 AND (ph < 6.0 OR ph > 9.0) THEN 'pH ' || CAST(ph AS VARCHAR)"
           " || ' is outside typical drinking water range (6.0-9.0)' END")
WARN_TDS = ("CASE WHEN tds BETWEEN 0 AND 5000 AND tds > 1000 THEN 'TDS ' || CAST(tds AS VARCHAR)"
            " || ' mg/L is high for drinking water' END")
WARN_TU = ("CASE WHEN turbidity BETWEEN 0 AND 100 AND turbidity > 10 THEN 'Turbidity ' "
           "|| CAST(turbidity AS VARCHAR) || ' NTU is high for drinking water' END")

VALIDATED = f"""validated AS (
  SELECT *, concat_ws('; ', {ERR_PH}, {ERR_TDS}, {ERR_TU}) AS errors_text,
         concat_ws('; ', {WARN_PH}, {WARN_TDS}, {WARN_TU}) AS warnings_text,
         CAST((CASE WHEN ph < 4.0 OR ph > 12.0 THEN 1 ELSE 0 END)
              + (CASE WHEN tds < 0 OR tds > 5000 THEN 1 ELSE 0 END)
              + (CASE WHEN turbidity < 0 OR turbidity > 100 THEN 1 ELSE 0 END) AS INTEGER) AS n_errors,
         CAST((CASE WHEN ph BETWEEN 4.0 AND 12.0 AND (ph < 6.0 OR ph > 9.0) THEN 1 ELSE 0 END)
              + (CASE WHEN tds BETWEEN 0 AND 5000 AND tds > 1000 THEN 1 ELSE 0 END)
              + (CASE WHEN turbidity BETWEEN 0 AND 100 AND turbidity > 10 THEN 1 ELSE 0 END)
              AS INTEGER) AS n_warnings
  FROM readings)"""


@query("p02_validate_first_error", RB + f"SELECT reading_id, {FIRST_ERROR_SQL} AS error FROM readings")
def p02_validate_first_error(spark, sf_dir):
    """First violated hard range (pH, then TDS, then turbidity)."""
    return readings(spark, sf_dir).select("reading_id", V.first_error().alias("error"))


@query("p03_validate_all", with_(READINGS, VALIDATED) + """
SELECT reading_id, n_errors = 0 AS valid, errors_text, warnings_text, n_errors, n_warnings
FROM validated""")
def p03_validate_all(spark, sf_dir):
    """All errors and warnings per reading, plus ``valid``."""
    v = readings(spark, sf_dir).transform(V.validate)
    return v.select("reading_id", "valid", F.array_join("errors", "; ").alias("errors_text"),
                    F.array_join("warnings", "; ").alias("warnings_text"),
                    F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query("p04_bounds_filter", RB + """
SELECT reading_id, tds, turbidity, ph FROM readings
WHERE tds BETWEEN 0 AND 5000 AND turbidity BETWEEN 0 AND 100 AND ph BETWEEN 4 AND 12""")
def p04_bounds_filter(spark, sf_dir):
    """Service-edge bounds as a filter on the computed readings."""
    return readings(spark, sf_dir).transform(V.bounds_filter).select(
        "reading_id", "tds", "turbidity", "ph")


@query("p08_batch_error_records", with_(READINGS, VALIDATED) + """
SELECT reading_id, row_number() OVER (ORDER BY reading_id) - 1 AS sample_index,
       CASE WHEN n_errors > 0 THEN errors_text END AS error,
       CASE WHEN n_warnings > 0 THEN warnings_text END AS warnings
FROM validated""")
def p08_batch_error_records(spark, sf_dir):
    """P8 + P10: every reading becomes a record with a 0-based
    ``sample_index``; invalid ones carry the joined errors."""
    out = readings(spark, sf_dir).transform(V.batch_error_records)
    return out.select("reading_id", "sample_index", "error",
                      F.array_join("warnings_or_null", "; ").alias("warnings"))


@query("p09_batch_drop_errors", RB + f"""
SELECT reading_id, tds, turbidity, ph FROM readings WHERE ({FIRST_ERROR_SQL}) IS NULL""")
def p09_batch_drop_errors(spark, sf_dir):
    """Silently drop failing rows."""
    return readings(spark, sf_dir).transform(V.batch_drop_errors).select(
        "reading_id", "tds", "turbidity", "ph")


@query("p10_row_numbers", RB + """
SELECT reading_id, row_number() OVER (ORDER BY reading_id) - 1 AS sample_index,
       row_number() OVER (ORDER BY reading_id) AS sample FROM readings""")
def p10_row_numbers(spark, sf_dir):
    """P10: 0-based and 1-based positions, distributed (no single-task
    window)."""
    df = V.with_row_index(readings(spark, sf_dir).select("reading_id"), "reading_id",
                          "sample_index", 0)
    return df.withColumn("sample", F.col("sample_index") + 1)


@query("p11_clip_readings", RB + """
SELECT reading_id, least(greatest(tds, 0e0), 5000e0) AS tds,
       least(greatest(turbidity, 0e0), 100e0) AS turbidity, least(greatest(ph, 4e0), 12e0) AS ph
FROM readings""")
def p11_clip_readings(spark, sf_dir):
    """Clip every sensor to its physical range."""
    return readings(spark, sf_dir).transform(V.clip_readings).select(
        "reading_id", "tds", "turbidity", "ph")


@query("p12_round_values", with_(READINGS, "valid AS (SELECT * FROM readings WHERE ph BETWEEN 4 AND 12 AND tds BETWEEN 0 AND 5000 AND turbidity BETWEEN 0 AND 100)")
       + f"SELECT reading_id, {py_round_sql('tds / 7', 1)} AS tds_per_7, "
       + f"{py_round_sql(SERVICE_WQI_SQL, 2)} AS wqi FROM valid")
def p12_round_values(spark, sf_dir):
    """Python-exact rounding of derived values (1 dp sensor, 2 dp
    index); the service WQI has many exact decimal ties (quirk Q-12)."""
    v = readings(spark, sf_dir).transform(V.valid_readings)
    return v.select("reading_id", py_round(F.col("tds") / 7, 1).alias("tds_per_7"),
                    py_round(wqi_service(), 2).alias("wqi"))
