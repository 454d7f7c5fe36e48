"""Agency compliance (J5): readings x agency standards as a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import AGENCY_STANDARDS, standards_bands


def agency_compliance(df: DataFrame, key: str = "reading_id") -> DataFrame:
    """Grade every reading against every agency's thresholds.

    Readings are unpivoted to (key, parameter, value) with ``stack`` and
    fanned out over the fixed agency list with ``explode``; the disjoint-band
    dimension (fixed size, so broadcasting it is bounded) is joined on
    (agency, parameter) with the range as the join condition; no band means
    ``poor``.  Map side only: no shuffle of the readings.
    """
    long = df.selectExpr(key, "stack(3, 'ph', ph, 'tds', tds, 'turbidity', turbidity) "
                              "AS (parameter, value)")
    bands = standards_bands(df.sparkSession)
    # one row per (reading, parameter, agency): a generator, not a join
    per_agency = long.withColumn(
        "agency", F.explode(F.array(*[F.lit(a) for a in AGENCY_STANDARDS])))
    lo_ok = F.when(F.col("b.lo_closed"), F.col("value") >= F.col("b.lo")).otherwise(
        F.col("value") > F.col("b.lo"))
    hi_ok = F.when(F.col("b.hi_closed"), F.col("value") <= F.col("b.hi")).otherwise(
        F.col("value") < F.col("b.hi"))
    cond = ((F.col("r.agency") == F.col("b.agency")) & (F.col("r.parameter") == F.col("b.parameter"))
            & lo_ok & hi_ok)
    j = per_agency.alias("r").join(F.broadcast(bands).alias("b"), cond, "left")
    return j.select(F.col(f"r.{key}").alias(key), F.col("r.agency").alias("agency"),
                    F.col("r.parameter").alias("parameter"), F.col("r.value").alias("value"),
                    F.coalesce(F.col("b.grade"), F.lit("poor")).alias("grade"))
