"""SMOTE reads its rows many times; they are parsed and classed only once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from limnos.operators.smote import nearest_neighbors, smote
from limnos.plans import QUERIES, load_all


def counted_rows(spark, n=300):
    """Rows whose class is made by a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def cls(i):
        calls.add(1)
        return int(i % 7 > 4)

    made = F.udf(cls, "int")
    ids = spark.range(n).select(F.col("id").alias("reading_id"), made("id").alias("quality"),
                                *[F.pmod(F.col("id") * m, F.lit(97)).cast("double").alias(f)
                                  for f, m in (("tds", 31), ("turbidity", 17), ("ph", 5))])
    return ids, calls


def test_smote_makes_each_row_once(spark):
    df, calls = counted_rows(spark)
    out = smote(df).collect()
    counts = {q: sum(r.quality == q for r in out) for q in (0, 1)}
    assert counts[0] == counts[1] == sum(i % 7 <= 4 for i in range(300))
    assert calls.value == 300


def test_neighbors_make_each_row_once(spark):
    df, calls = counted_rows(spark)
    assert nearest_neighbors(df, 5).count() == 1500
    assert calls.value == 300


@pytest.mark.parametrize("name", ["a12_imbalance_ratio", "m09_smote_resample", "j02_smote_neighbors"])
def test_result_does_not_scan_the_table_again(spark, tmp_path, name):
    load_all()
    (spark.range(240).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"),
        (F.col("id") % 11).alias("user_id"), F.lit("view").alias("event_type"),
        (F.col("id") * 0.9).alias("value"), F.format_string('{"k": %d}', F.col("id") % 50).alias("props"))
     .write.parquet(str(tmp_path / "events.parquet")))
    out = QUERIES[name](spark, str(tmp_path))
    assert out.count() > 0
    assert not [f for f in out.inputFiles() if "events.parquet" in f]
