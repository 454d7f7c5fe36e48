"""Sources and sinks as round trips (S1-S5, S7, S8): write under the shared
checkpoint folder, read back with an explicit schema, compare by value."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import MODEL_FEATURES
from ..operators import ml
from ..schema import LABELLED, QUALITY_LABELS
from ..session import scratch_path
from ..sources import files
from . import query
from .common import labelled, r
from .q_confidence import CHAIN, scored
from .q_ml import CAL, split_sql
from .sql import BASE, READINGS, with_

LAB_COLS = ["tds", "turbidity", "ph", "quality", "quality_label"]


@query("s01_csv_roundtrip", BASE + "SELECT tds, turbidity, ph, quality, quality_label FROM labelled")
def s01_csv_roundtrip(spark, sf_dir):
    """S1 + S4 + S5: labelled dataset -> headered CSV -> read back with the
    explicit schema -> row count and columns verified."""
    df = labelled(spark, sf_dir).select(*LAB_COLS)
    path = scratch_path(spark, "io", "labelled_csv")
    files.write_and_verify(df, path, "csv")
    return files.read_labelled_csv(spark, path, LABELLED)


@query("s02_first_existing", BASE + "SELECT tds, turbidity, ph, quality, quality_label FROM labelled")
def s02_first_existing(spark, sf_dir):
    """The first existing of (resampled, original): the resampled path
    is absent here, so the original is read."""
    df = labelled(spark, sf_dir).select(*LAB_COLS)
    original = scratch_path(spark, "io", "original")
    files.write_csv(df, original)
    missing = scratch_path(spark, "io", "resampled_absent")
    return files.read_first_existing(spark, [missing, original])


@query("s03_uploaded_csv", with_(READINGS) + "SELECT tds, turbidity, ph, reading_id, site FROM readings")
def s03_uploaded_csv(spark, sf_dir):
    """S3: uploaded CSV with the required-column check (cast to double)."""
    from ..sources.readings import readings
    df = readings(spark, sf_dir).select("reading_id", "site", "tds", "turbidity", "ph")
    path = scratch_path(spark, "io", "upload")
    files.write_csv(df, path)
    up = files.read_uploaded_csv(spark, path)
    return up.select("tds", "turbidity", "ph", F.col("reading_id").cast("long").alias("reading_id"),
                     "site")


RECORD_SCHEMA = T.StructType([
    T.StructField("reading_id", T.LongType()),
    T.StructField("quality_class", T.IntegerType()),
    T.StructField("quality_label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("recommendation", T.StringType()),
])


@query("s07_json_roundtrip", CHAIN + """
SELECT reading_id, quality_class, quality_label, round(confidence, 6) AS confidence, recommendation FROM chain""")
def s07_json_roundtrip(spark, sf_dir):
    """Prediction records -> JSON documents -> JSON files -> parsed back
    against an explicit schema."""
    recs = scored(spark, sf_dir).select(*[f.name for f in RECORD_SCHEMA.fields])
    docs = files.to_json_records(recs)
    path = scratch_path(spark, "io", "records_json")
    docs.write.mode("overwrite").text(path)
    back = files.from_json_records(spark.read.text(path).withColumnRenamed("value", "json"),
                                   RECORD_SCHEMA)
    return back.select("reading_id", "quality_class", "quality_label",
                       r("confidence").alias("confidence"), "recommendation")


@query("s08_run_metadata", CAL + split_sql("cal") + """
SELECT 35 AS n_features, (SELECT count(*) FROM sp WHERE split = 'train') AS training_samples,
       (SELECT round(avg(CASE WHEN model_class = quality THEN 1e0 ELSE 0e0 END), 6)
        FROM sp WHERE split = 'test') AS test_accuracy, 'rule-v1' AS model_version""")
def s08_run_metadata(spark, sf_dir):
    """Run metadata (features, labels, training rows, test accuracy of
    the scorer) as a one-row JSON document, read back."""
    from ..functions.arrays import argmax
    from ..operators.score import rule_model
    sp = ml.stratified_split(labelled(spark, sf_dir).transform(rule_model))
    n_train = sp.where(F.col("split") == "train").count()
    acc = (sp.where(F.col("split") == "test")
           .agg(F.avg((argmax("probability") == F.col("quality")).cast("double"))).collect()[0][0])
    md = files.write_run_metadata(spark, scratch_path(spark, "io", "run_metadata"), MODEL_FEATURES,
                                  QUALITY_LABELS, "rule-v1", n_train, acc)
    return md.select(F.size("feature_names").alias("n_features"),
                     F.col("training_samples").cast("long").alias("training_samples"),
                     r("test_accuracy").alias("test_accuracy"), "model_version")


@query("s13_preview", BASE + """
SELECT reading_id, tds, turbidity, ph, quality_label FROM labelled ORDER BY reading_id LIMIT 5""")
def s13_preview(spark, sf_dir):
    """Deterministic head(5) of the labelled dataset (an ordered
    limit: the preview is the feature)."""
    return files.preview(labelled(spark, sf_dir).select("reading_id", "tds", "turbidity", "ph",
                                                        "quality_label"), ["reading_id"], 5)
