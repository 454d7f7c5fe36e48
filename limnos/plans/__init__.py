"""Registered query plans: each is ``(spark, sf_dir) -> DataFrame`` built from
the library's operators over the driver tables, with an independent DuckDB
SQL oracle where the operator is expressible in SQL."""

from __future__ import annotations

from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: Dict[str, QueryFn] = {}
ORACLE: Dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (and its oracle SQL, if any)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import (q_classify, q_features, q_scoring, q_validate, q_profile,  # noqa: F401
                   q_confidence, q_ml, q_stream, q_io)
