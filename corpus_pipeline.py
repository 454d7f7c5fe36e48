"""A training-data pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, mixing sources to target weights, sharding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limnos.llm._common import shared_path, table
from limnos.llm.queries import STAGES

#: SQL has no XXH64, seeded forest or seeded shuffle: the stages are tested
#: against brute-force versions in tests/llm instead.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
