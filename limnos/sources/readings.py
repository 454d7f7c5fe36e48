"""Readings adapters: project sensor readings out of the driver tables.

The adapters only map columns of a given table onto the reading schema
``(reading_id, sensor_id, site, ts, tds, turbidity, ph)``; they do none of the
operators' work.  Every operator is written against that schema and runs on
any data of that shape.  Only the needed columns are selected, so the
Parquet scan prunes the rest.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READING_COLUMNS = ["reading_id", "sensor_id", "site", "ts", "tds", "turbidity", "ph"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events_to_readings(ev: DataFrame) -> DataFrame:
    """Map an ``events``-shaped frame (batch or stream) to readings.  ``ts``
    stays TIMESTAMP_NTZ (wall clock)."""
    return ev.select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("sensor_id"),
        F.col("event_type").alias("site"),
        F.col("ts"),
        F.round(F.col("value") * 12.0, 2).alias("tds"),
        (F.get_json_object("props", "$.k").cast("int") / 4.0).alias("turbidity"),
        ((35 + F.pmod(F.col("event_id") * 13, F.lit(36)) + F.pmod(F.col("user_id") * 7, F.lit(36)))
         / 10.0).alias("ph"),
    )


def events_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` -> readings."""
    return events_to_readings(table(spark, sf_dir, "events"))


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` -> readings (the volume table, 6x ``events``).  Sensor
    values carry few decimals (whole mg/L, half NTU, tenth pH)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("reading_id"),
        F.col("l_suppkey").alias("sensor_id"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("site"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.floor(F.col("l_extendedprice") / 20.0).cast("double").alias("tds"),
        (F.col("l_quantity") / 2.0).alias("turbidity"),
        ((35 + F.pmod(F.col("l_partkey"), F.lit(71))) / 10.0).alias("ph"),
    )


ADAPTERS = {"events": events_readings, "lineitem": lineitem_readings}


def readings(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    """Readings of a source table.  A session whose files have too few splits
    for its cores may set ``limnos.input.partitions`` to deal rows out anew
    (local runs on one row group do); unset, the scan's splits stay."""
    df = ADAPTERS[source](spark, sf_dir)
    parts = spark.conf.get("limnos.input.partitions", None)
    return df.repartition(int(parts)) if parts else df
