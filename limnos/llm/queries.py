"""Registered queries of the operators and the pipeline, with the DuckDB
SQL of those that SQL can express."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, language_id, licenses, line_dedup, mixing, periodic_runs, quality_classifier, quality_rules,
               secret_scan, sharding, simhash, token_align, toxicity)
from ._common import shared_path, table

N_SHARDS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents into 16 shards and digest what was written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_path(spark, "shards")
    sharding.write_shards(sharding.shuffle_to_shards(docs, N_SHARDS), path)
    out = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot",
                      sharding.shard_of(F.col("doc_id"), N_SHARDS + 1).alias("grown_shard"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.isolation_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "anomaly")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                      "spans", "n_live", "n_example")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_corpus(table(spark, sf_dir, "documents"))


def repeat_tail(doc_id, words: list) -> list:
    """The contract's edit of one document in ten: its words from some place on
    become repetitions of the first of them.  A null id leaves them as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(table(spark, sf_dir, "documents"), edit=repeat_tail)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"),
                                                              (-r["period"]).alias("shorter"))))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.shorter")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ---------------------------------------------------------------- pipeline stages

def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_per_group(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts that the mix takes, a row for each copy."""
    return mixing.mixed_documents(docs)


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shuffle_to_shards(docs, N_SHARDS)


STAGES = [("quality_rules", stage_quality_rules), ("simhash_near_dedup", stage_near_duplicates),
          ("benchmark_decontamination", stage_decontamination), ("source_mixing", stage_mixing), ("sharding", stage_sharding)]

QUERIES = {f.__name__: f for f in (op1_sharding, op2_simhash, op3_quality_rules, op4_license_scan, op5_line_dedup,
                                   op6_quality_classifier, op7_language_id, op8_secret_scan, op9_decontamination, op10_mixing,
                                   op11_token_alignment, op12_periodic_runs, op13_toxicity)}

_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), " \
       "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op5_line_dedup": f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS MATERIALIZED (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS MATERIALIZED (SELECT r, doc_id, i, line, {_KEY} AS key FROM lines),
often AS MATERIALIZED (SELECT key FROM (SELECT DISTINCT r, key FROM keyed WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10)
SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN o.key IS NULL THEN k.line END, chr(10) ORDER BY k.i), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY k.r""",
}
