"""File sources and sinks."""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LABELLED, require_columns


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    local, HDFS and object stores alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_labelled_csv(spark: SparkSession, path: str,
                      schema: T.StructType = LABELLED) -> Optional[DataFrame]:
    """Headered CSV with an explicit schema; ``None`` if missing."""
    if not path_exists(spark, path):
        return None
    return spark.read.schema(schema).option("header", True).csv(path)


def read_first_existing(spark: SparkSession, paths: Iterable[str],
                        schema: T.StructType = LABELLED) -> Optional[DataFrame]:
    """The first path that exists (e.g. resampled, then original)."""
    for p in paths:
        df = read_labelled_csv(spark, p, schema)
        if df is not None:
            return df
    return None


def read_uploaded_csv(spark: SparkSession, path: str,
                      required=("tds", "turbidity", "ph")) -> DataFrame:
    """S3: uploaded CSV, required-column check that raises."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(df, required)
    return df.select(*[F.col(c).cast("double").alias(c) for c in required],
                     *[c for c in df.columns if c not in required])


def write_csv(df: DataFrame, path: str) -> str:
    """CSV sink with header, no index."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_and_verify(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Write, then read back with the same schema and verify the row
    count and column list.  Returns the re-read frame."""
    spark = df.sparkSession
    if fmt == "csv":
        write_csv(df, path)
        back = spark.read.schema(df.schema).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
        back = spark.read.schema(df.schema).json(path)
    else:
        df.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
    if back.columns != df.columns:
        raise ValueError(f"column mismatch after write: {back.columns} != {df.columns}")
    n_in, n_out = df.count(), back.count()
    if n_in != n_out:
        raise ValueError(f"row count mismatch after write: {n_in} != {n_out}")
    return back


def to_json_records(df: DataFrame, name: str = "json") -> DataFrame:
    """S7 out: one JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def from_json_records(df: DataFrame, schema: T.StructType, name: str = "json") -> DataFrame:
    """S7 in: parse JSON documents against an explicit schema."""
    return df.select(F.from_json(F.col(name), schema).alias("_r")).select("_r.*")


def write_run_metadata(spark: SparkSession, path: str, feature_names, quality_labels,
                       model_version: str, training_samples: int,
                       test_accuracy: float) -> DataFrame:
    """One-row run-metadata JSON document."""
    md = spark.createDataFrame(
        [(list(feature_names), {str(k): v for k, v in quality_labels.items()},
          model_version, int(training_samples), float(test_accuracy))],
        "feature_names array<string>, quality_labels map<string,string>, "
        "model_version string, training_samples int, test_accuracy double")
    md.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema(md.schema).json(path)


def preview(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """Deterministic head(n) (ordered limit: a top-k)."""
    return df.orderBy(*order_by).limit(n)
