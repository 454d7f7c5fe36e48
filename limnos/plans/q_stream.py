"""Structured Streaming queries (T1-T4): each runs the stream over the
``events`` file source to completion (availableNow) and returns the sink."""

from __future__ import annotations

from ..operators.score import disagreeing_model
from ..streaming import monitor as M
from . import query
from .common import r
from .q_confidence import CHAIN, CHAIN_DISAGREE

CLASS_COLS_SQL = ",\n       ".join(
    f"round(count_if(quality_label = '{c}') / CAST(count(*) AS DOUBLE), 6) AS share_{c.lower()}, "
    + ", ".join(f"round(avg(CASE WHEN quality_label = '{c}' THEN {s} END), 6) AS avg_{s}_{c.lower()}"
                for s in ("tds", "turbidity", "ph"))
    for c in ("Poor", "Acceptable", "Good", "Excellent"))

REPORT_COLS_SQL = """count(*) AS n, count_if(quality_label = 'Poor') AS poor_alerts,
       count_if(confidence < 0.7e0) AS low_confidence, round(avg(confidence), 6) AS mean_confidence,
       round(avg(tds), 6) AS avg_tds, round(avg(turbidity), 6) AS avg_turbidity,
       round(avg(ph), 6) AS avg_ph,
       """ + CLASS_COLS_SQL

REPORT_COLS = ["n", "poor_alerts", "low_confidence"]
ROUNDED = ["mean_confidence", "avg_tds", "avg_turbidity", "avg_ph", *M.class_report_columns()]


def _report_out(df, keys):
    return df.select(*keys, *REPORT_COLS, *[r(c).alias(c) for c in ROUNDED])


@query("t01_stream_scored", CHAIN + """
SELECT reading_id, sensor_id, quality_class, quality_label, round(confidence, 6) AS confidence FROM chain""")
def t01_stream_scored(spark, sf_dir):
    """Score each arriving reading, invalid ones dropped (append sink)."""
    out = M.run_append(spark, M.scored_stream(M.events_stream(spark, sf_dir)), "t01")
    return out.select("reading_id", "sensor_id", "quality_class", "quality_label",
                      r("confidence").alias("confidence"))


@query("t02_stream_window_report", CHAIN + f"""
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       site, {REPORT_COLS_SQL}
FROM chain GROUP BY date_trunc('day', ts), site""")
def t02_stream_window_report(spark, sf_dir):
    """Per-day, per-site session report with a 1-hour watermark
    (update mode; final state per window)."""
    stream = M.window_report(M.scored_stream(M.events_stream(spark, sf_dir)))
    out = M.run_update(spark, stream, ["window_start", "site"], "t02")
    return _report_out(out, ["window_start", "window_end", "site"])


@query("t03_stream_alerts", CHAIN + """
SELECT reading_id, sensor_id, quality_label, round(confidence, 6) AS confidence,
       quality_label = 'Poor' AS is_poor, confidence < 0.7e0 AS is_low_confidence
FROM chain WHERE quality_label = 'Poor' OR confidence < 0.7e0""")
def t03_stream_alerts(spark, sf_dir):
    """Poor-quality and low-confidence alerts (append sink)."""
    out = M.run_append(spark, M.alerts(M.scored_stream(M.events_stream(spark, sf_dir))), "t03")
    return out.select("reading_id", "sensor_id", "quality_label",
                      r("confidence").alias("confidence"), "is_poor", "is_low_confidence")


@query("t03_stream_alerts_disagreeing", CHAIN_DISAGREE + """
SELECT reading_id, sensor_id, quality_label, round(confidence, 6) AS confidence,
       quality_label = 'Poor' AS is_poor, confidence < 0.7e0 AS is_low_confidence
FROM chain WHERE quality_label = 'Poor' OR confidence < 0.7e0""")
def t03_stream_alerts_disagreeing(spark, sf_dir):
    """T3 on the stand-in model that disagrees with the rules."""
    out = M.run_append(spark, M.alerts(M.scored_stream(M.events_stream(spark, sf_dir), disagreeing_model)), "t03d")
    return out.select("reading_id", "sensor_id", "quality_label",
                      r("confidence").alias("confidence"), "is_poor", "is_low_confidence")


@query("t04_stream_sessions", CHAIN + f"""
, s AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts) IS NULL
                        OR ts - lag(ts) OVER (PARTITION BY sensor_id ORDER BY ts) >= INTERVAL 2 HOUR
                       THEN 1 ELSE 0 END AS new_session FROM chain)
, g AS (SELECT *, sum(new_session) OVER (PARTITION BY sensor_id ORDER BY ts
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM s)
, sess AS (SELECT sensor_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end,
                  {REPORT_COLS_SQL}
           FROM g GROUP BY sensor_id, sid)
SELECT * FROM sess""")
def t04_stream_sessions(spark, sf_dir):
    """T4: one report per monitoring session (2-hour inactivity gap) per
    sensor: session windows in append mode, emitted once the watermark (max
    event time - 1 hour) passes their end; those still open when the input
    ends are read from the query's state."""
    out = M.run_sessions(spark, M.events_stream(spark, sf_dir), "t04")
    return _report_out(out, ["sensor_id", "session_start", "session_end"])
