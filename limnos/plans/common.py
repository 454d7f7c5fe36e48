"""Shared building blocks for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import label_readings
from ..operators.validate import valid_readings
from ..sources.readings import readings


def r(c, digits: int = 6) -> Column:
    """Output rounding so two engines' last-bit differences do not matter:
    round half away from zero of x * 10^n, then / 10^n — plain double
    arithmetic (no per-value BigDecimal like ``F.round``), bit-identical to
    SQL engines that round doubles this way (DuckDB does)."""
    x = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    y = x * scale
    # the double before 0.5: what is below a half stays below, and a half itself reaches the next number;
    # short and without branches, as dozens stand in one projection; + 0.0: no -0.0
    return (F.signum(y) * F.floor(F.abs(y) + 0.49999999999999994) + 0.0) / scale


def rounded(columns, digits: int = 6) -> list:
    """``r`` of each of many columns under its own name.  The first is rounded
    through an array: Spark does not fuse a projection with an array function
    into one long method with its neighbours, which the JVM would not compile,
    but splits its code."""
    first, *rest = columns
    held = F.transform(F.array(first), lambda x: r(x, digits))[0]
    return [held.alias(first), *[r(c, digits).alias(c) for c in rest]]


def valid(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    return readings(spark, sf_dir, source).transform(valid_readings)


def labelled(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    return valid(spark, sf_dir, source).transform(label_readings)
