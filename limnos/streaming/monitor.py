"""Live monitoring as Structured Streaming (T1-T4) and its batch twin.

Every function takes a streaming *or* a batch DataFrame of readings, so the
batch twin is the same code.  Stateful parts (windowed report, sessions)
are bounded by the watermark; the stateless scored stream (T1) and the
alerts (T3) keep late rows.
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.score import rule_model, score
from ..schema import QUALITY_LABELS
from ..session import scratch_path
from ..sources.readings import events_to_readings

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
LOW_CONFIDENCE = 0.7
SENSORS = ("tds", "turbidity", "ph")


def event_time(ts: str = "ts") -> Column:
    """Wall-clock TIMESTAMP_NTZ -> TIMESTAMP instant read as UTC, independent
    of the session time zone (watermarks need TIMESTAMP)."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})"))


def wall_clock(instant: str) -> Column:
    """Inverse of ``event_time``: instant column (SQL name) -> UTC wall
    clock as NTZ."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({instant}), {_EPOCH})")


def scored_stream(readings: DataFrame, model=rule_model) -> DataFrame:
    """Score each arriving reading, drop invalid ones (stateless)."""
    s = score(readings, model)
    return s.select("reading_id", "sensor_id", "site", "ts", "tds", "turbidity", "ph",
                    "quality_class", "quality_label", "confidence",
                    event_time("ts").alias("event_ts"))


def alerts(scored: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """Poor readings and low-confidence predictions (stateless)."""
    poor = F.col("quality_label") == "Poor"
    lowc = F.col("confidence") < low
    return scored.where(poor | lowc).select(
        "reading_id", "sensor_id", "ts", "quality_label", "confidence",
        poor.alias("is_poor"), lowc.alias("is_low_confidence"))


def class_report_columns() -> list[str]:
    """Names of the report's columns by class: share of the readings and mean
    of each sensor, per label."""
    return [c for label in QUALITY_LABELS.values() for c in
            (f"share_{label.lower()}", *[f"avg_{s}_{label.lower()}" for s in SENSORS])]


def _class_aggs() -> list[Column]:
    aggs = []
    for label in QUALITY_LABELS.values():
        mine = F.col("quality_label") == label
        aggs.append((F.count_if(mine) / F.count(F.lit(1))).alias(f"share_{label.lower()}"))
        aggs += [F.avg(F.when(mine, F.col(s))).alias(f"avg_{s}_{label.lower()}") for s in SENSORS]
    return aggs


def _report_aggs(low: float = LOW_CONFIDENCE):
    return [F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("quality_label") == "Poor").alias("poor_alerts"),
            F.count_if(F.col("confidence") < low).alias("low_confidence"),
            F.avg("confidence").alias("mean_confidence"),
            F.avg("tds").alias("avg_tds"), F.avg("turbidity").alias("avg_turbidity"),
            F.avg("ph").alias("avg_ph"), *_class_aggs()]


def window_report(scored: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                  by: Sequence[str] = ("site",)) -> DataFrame:
    """The session report (A18) per tumbling event-time window and key."""
    w = scored.withWatermark("event_ts", watermark)
    agg = w.groupBy(F.window("event_ts", window).alias("w"), *by).agg(*_report_aggs())
    return agg.select(wall_clock("w.start").alias("window_start"),
                      wall_clock("w.end").alias("window_end"), *by,
                      *[c for c in agg.columns if c not in ("w", *by)])


def sessions(scored: DataFrame, gap: str = "2 hours", watermark: str = "1 hour",
             by: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """T4 as one stateful operator: one report per monitoring session (activity
    separated by ``gap``) and sensor.  A stream emits a session once the
    watermark passes its end; ``run_sessions`` also reports the open ones."""
    w = scored.withWatermark("event_ts", watermark)
    agg = w.groupBy(F.session_window("event_ts", gap).alias("s"), *by).agg(*_report_aggs())
    return agg.select(*by, wall_clock("s.start").alias("session_start"),
                      wall_clock("s.end").alias("session_end"),
                      *[c for c in agg.columns if c not in ("s", *by)])


SPLIT = 16     # parts into which a batch's readings of a sensor are divided before their sessions are merged


def _session_sums(low: float = LOW_CONFIDENCE) -> dict[str, Column]:
    """The session report as sums and counts, which add up over parts."""
    aggs = {"n": F.count(F.lit(1)), "poor_alerts": F.count_if(F.col("quality_label") == "Poor"),
            "low_confidence": F.count_if(F.col("confidence") < low), "sum_confidence": F.sum("confidence"),
            **{f"sum_{s}": F.sum(s) for s in SENSORS}}
    for label in QUALITY_LABELS.values():
        mine = F.col("quality_label") == label
        aggs[f"n_{label.lower()}"] = F.count_if(mine)
        aggs.update({f"sum_{s}_{label.lower()}": F.sum(F.when(mine, F.col(s))) for s in SENSORS})
    return aggs


def partial_sessions(scored: DataFrame, gap: str, by: Sequence[str]) -> DataFrame:
    """Sessions within each of ``SPLIT`` parts of a batch's readings: key, start,
    end (last reading + gap) and sums.  No sensor's readings meet in one task."""
    aggs = _session_sums()
    agg = scored.groupBy(F.session_window("event_ts", gap).alias("s"), *by, F.pmod(F.xxhash64("reading_id", "ts"), F.lit(SPLIT)).alias("_part")) \
                .agg(*[a.alias(n) for n, a in aggs.items()])
    return agg.select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), *aggs)


def merged_sessions(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sessions of the same key that overlap are one; sums add up."""
    rows = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(rows.rowsBetween(Window.unboundedPreceding, -1))
    sums = [c for c in parts.columns if c not in (*by, "start", "end")]
    marked = parts.withColumn("_new", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    return (marked.withColumn("_session", F.sum("_new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*by, "_session").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(c).alias(c) for c in sums])
            .drop("_session"))


def session_rows(sums: DataFrame, by: Sequence[str] = ("sensor_id",)) -> DataFrame:
    """The session report from its sums: shares and means, by class too."""
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n))
    classes = [c for label in map(str.lower, QUALITY_LABELS.values()) for c in
               ((F.col(f"n_{label}") / F.col("n")).alias(f"share_{label}"),
                *[mean(f"sum_{s}_{label}", f"n_{label}").alias(f"avg_{s}_{label}") for s in SENSORS])]
    return sums.select(*by, wall_clock("start").alias("session_start"), wall_clock("end").alias("session_end"),
                       "n", "poor_alerts", "low_confidence", mean("sum_confidence", "n").alias("mean_confidence"),
                       *[mean(f"sum_{s}", "n").alias(f"avg_{s}") for s in SENSORS], *classes)


def session_report(scored: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """One aggregation — readings, first / last timestamp (first before
    last, quirk Q-19), Poor alerts, low-confidence count, and the share and
    mean sensors of each class."""
    return scored.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"),
                      F.max("ts").alias("last_ts"),
                      F.count_if(F.col("quality_label") == "Poor").alias("poor_alerts"),
                      F.count_if(F.col("confidence") < low).alias("low_confidence"), *_class_aggs())


# -- running a stream to completion (file source, availableNow) -------------

def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as a stream over the ``events`` parquet, one file or a folder
    of part files (the deploy form swaps the file source for Kafka; the
    operators do not change)."""
    # a pattern, because the file source takes a plain path for a folder
    raw = spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parque[t]")
    return events_to_readings(raw)


def _start(writer, path: str) -> None:
    """Run a query over all input there is.  Its progress lives in the folder
    ``ckpt`` of ``path``: started again with the same path, it goes on with
    the input that is new."""
    q = writer.option("checkpointLocation", os.path.join(path, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()


def run_append(spark: SparkSession, stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Append-mode query into a parquet sink; returns the sink read back as a
    batch frame.  ``path`` (shared storage) holds progress and output and makes
    the query one that can be stopped and started again: the sink's own manifest
    names the files of finished batches.  Without it each call starts afresh
    under the shared checkpoint folder."""
    path = path or scratch_path(spark, "stream", name)
    out = os.path.join(path, "out")
    _start(stream.writeStream.format("parquet").outputMode("append").option("path", out), path)
    return spark.read.schema(stream.schema).parquet(out)


def run_sessions(spark: SparkSession, readings_stream: DataFrame, name: str, model=rule_model,
                 by: Sequence[str] = ("sensor_id",), gap: str = "2 hours", watermark: str = "1 hour",
                 path: str | None = None) -> DataFrame:
    """T4 up to the monitor's stop: the closed sessions and those still open.

    Each micro-batch scores its readings once, reduces them to partial sessions
    and merges these with the sessions that the batch before left open (the only
    state, one row a session, in the batch's folder).  A session is closed once
    the watermark (latest event time seen less ``watermark``) reaches its end.

    One rule for late readings: one older than the watermark that its batch
    begins with is dropped; any other counts, and can meet no closed session.
    With a ``path`` on shared storage the monitor can be stopped and started
    again; an open session then grows or closes in the next run."""
    path = path or scratch_path(spark, "stream", name)
    folder = lambda kind, i: os.path.join(path, kind, f"_batch={i}")
    manifest = os.path.join(path, "manifest")
    scored = scored_stream(readings_stream, model)

    def step(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        before = [e for e in finished_batches(s, manifest) if e["batch"] < batch_id][-1:]
        seen = before[0]["seen"] if before else None
        if seen is not None:
            batch = batch.where(F.col("event_ts") >= F.lit(seen) - F.expr(f"INTERVAL {watermark}"))
        partial_sessions(batch, gap, by).write.mode("overwrite").parquet(folder("partial", batch_id))
        parts = s.read.parquet(folder("partial", batch_id))
        latest = parts.agg(F.max("end") - F.expr(f"INTERVAL {gap}")).collect()[0][0]
        seen = max((t for t in (seen, latest) if t is not None), default=None)
        if before:
            parts = parts.unionByName(s.read.parquet(folder("sessions", before[0]["batch"])).where("NOT closed").drop("closed"))
        closed = F.lit(False) if seen is None else F.col("end") <= F.lit(seen) - F.expr(f"INTERVAL {watermark}")
        merged_sessions(parts, by).withColumn("closed", closed).write.mode("overwrite").parquet(folder("sessions", batch_id))
        enter_batch(s, manifest, batch_id, seen)

    _start(scored.writeStream.foreachBatch(step), path)
    done = [e["batch"] for e in finished_batches(spark, manifest)]
    if not done:
        return sessions(spark.createDataFrame([], scored.schema), gap, watermark, by)
    written = spark.read.option("basePath", os.path.join(path, "sessions")).parquet(*[folder("sessions", i) for i in done])
    return session_rows(written.where(F.col("closed") | (F.col("_batch") == done[-1])), by)


def run_update(spark: SparkSession, stream: DataFrame, keys: Sequence[str], name: str, path: str | None = None) -> DataFrame:
    """Update-mode stateful query: each micro-batch's changed rows are written
    under its batch id, then the batch is entered in a manifest (both
    ``foreachBatch``, repeated as they were if the query stops in between).
    Reading back takes the batches of the manifest and keeps the latest version
    of every key: the complete result, including windows still open.  With a
    ``path`` on shared storage the query can be stopped and started again."""
    path = path or scratch_path(spark, "stream", name)
    out, manifest = os.path.join(path, "out"), os.path.join(path, "manifest")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={batch_id}"))
        enter_batch(batch.sparkSession, manifest, batch_id)

    _start(stream.writeStream.outputMode("update").foreachBatch(sink), path)
    done = [e["batch"] for e in finished_batches(spark, manifest)]
    if not done:
        return spark.createDataFrame([], stream.schema)
    written = spark.read.option("basePath", out).parquet(*[os.path.join(out, f"_batch={i}") for i in done])
    latest = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    # one row per key per batch: partitioned by key, never one task
    return (written.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1")
            .select(*stream.columns))


def enter_batch(spark: SparkSession, manifest: str, batch_id: int, seen=None) -> None:
    """Note that all rows of a batch are written, and the latest event time seen."""
    entry = spark.range(batch_id, batch_id + 1).select(F.col("id").alias("batch"), F.lit(seen).cast("timestamp").alias("seen"))
    entry.write.mode("overwrite").parquet(os.path.join(manifest, f"entry={batch_id}"))


def finished_batches(spark: SparkSession, manifest: str) -> list:
    """Entries (batch, seen) of the manifest in order, one row a batch; none before the first."""
    try:
        return sorted(spark.read.schema("batch long, seen timestamp").parquet(manifest).select("batch", "seen").collect(),
                      key=lambda e: e["batch"])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
