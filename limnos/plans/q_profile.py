"""Profiling and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from ..sources.readings import readings
from ..sources.samples import sample_n
from ..streaming.monitor import class_report_columns, session_report
from . import query
from .common import labelled, r
from .q_confidence import CHAIN, scored
from .q_stream import CLASS_COLS_SQL
from .sql import BASE, HASH_SQL, READINGS, with_

SENS = ["tds", "turbidity", "ph"]

DESCRIBE_SQL = BASE + "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
       max({c}) AS max FROM labelled""" for c in SENS)


@query("a03_describe", DESCRIBE_SQL)
def a03_describe(spark, sf_dir):
    """A3: describe() of the sensors with exact linear-interpolated
    quartiles (distributed order statistics, no collect of the column)."""
    d = profile.describe(labelled(spark, sf_dir), SENS)
    return d.select("column", "count", r("mean").alias("mean"), r("std").alias("std"), "min",
                    r("p25").alias("p25"), r("p50").alias("p50"), r("p75").alias("p75"), "max")


CORR_COLS = ["tds", "turbidity", "ph", "quality"]


@query("a06_corr_matrix", BASE + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM labelled"
    for a in CORR_COLS for b in CORR_COLS))
def a06_corr_matrix(spark, sf_dir):
    """Pearson correlation matrix (one aggregation)."""
    c = profile.corr_matrix(labelled(spark, sf_dir), CORR_COLS)
    return c.select("col_a", "col_b", r("corr").alias("corr"))


def _hist_sql(src: str, value: str, by: str, bins: int) -> str:
    return f"""
, rg AS (SELECT {by}, min({value}) AS mn, max({value}) AS mx FROM {src} GROUP BY {by})
, rr AS (SELECT {by}, CASE WHEN mn = mx THEN mn - 0.5e0 ELSE mn END AS lo,
                CASE WHEN mn = mx THEN mx + 0.5e0 ELSE mx END AS hi FROM rg)
, bb AS (SELECT s.{by}, CAST(least(floor((s.{value} - lo) * ({bins} / (hi - lo))), {bins - 1}) AS INTEGER) AS bin
         FROM {src} s JOIN rr ON s.{by} = rr.{by})
, cc AS (SELECT {by}, bin, count(*) AS n FROM bb GROUP BY {by}, bin)
, gg AS (SELECT {by}, lo, hi, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM rr)
SELECT gg.{by}, gg.bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, coalesce(cc.n, 0) AS n
FROM gg LEFT JOIN cc USING ({by}, bin)"""


def _hist_out(h, by):
    return h.select(by, "bin", r("bin_lo").alias("bin_lo"), r("bin_hi").alias("bin_hi"), "n")


@query("a07_hist_by_quality", BASE + _hist_sql("labelled", "tds", "quality_label", 30))
def a07_hist_by_quality(spark, sf_dir):
    """30-bin TDS histogram per class over each class's own range."""
    return _hist_out(profile.histogram_by_class(labelled(spark, sf_dir), "tds", "quality_label", 30),
                     "quality_label")


def _register_hist(column: str) -> None:
    @query(f"a07_hist_by_quality_{column}", BASE + _hist_sql("labelled", column, "quality_label", 30))
    def histogram(spark, sf_dir):
        return _hist_out(profile.histogram_by_class(labelled(spark, sf_dir), column, "quality_label", 30), "quality_label")
    histogram.__doc__ = f"A7: 30-bin {column} histogram per class over each class's own range."


_register_hist("turbidity")
_register_hist("ph")


@query("a08_hist_confidence", CHAIN + _hist_sql("chain", "confidence", "quality_label", 20))
def a08_hist_confidence(spark, sf_dir):
    """Exactly 20 confidence bins per predicted class."""
    return _hist_out(profile.histogram_by_class(scored(spark, sf_dir), "confidence",
                                                "quality_label", 20), "quality_label")


NULL_COLS = [("reading_id", "bigint"), ("sensor_id", "bigint"), ("site", "string"),
             ("ts", "timestamp_ntz"), ("tds", "double"), ("turbidity", "double"), ("ph", "double")]


@query("a09_null_counts", with_(READINGS) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) "
    + (f"+ count_if(isnan({c})) " if t == "double" else "")
    + f"AS BIGINT) AS null_count, '{t}' AS dtype FROM readings" for c, t in NULL_COLS))
def a09_null_counts(spark, sf_dir):
    """NULL-or-NaN count and type per column."""
    return profile.null_counts(readings(spark, sf_dir))


@query("a17_confidence_stats", CHAIN + """
SELECT round(avg(confidence), 6) AS mean_confidence,
       round(avg(CASE WHEN confidence > 0.9e0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS pct_high FROM chain""")
def a17_confidence_stats(spark, sf_dir):
    """Mean confidence and % of rows above 0.9."""
    s = profile.confidence_stats(scored(spark, sf_dir))
    return s.select(r("mean_confidence").alias("mean_confidence"), r("pct_high").alias("pct_high"))


@query("a18_session_report", CHAIN + """
SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
       count_if(quality_label = 'Poor') AS poor_alerts,
       count_if(confidence < 0.7e0) AS low_confidence,
       """ + CLASS_COLS_SQL + " FROM chain")
def a18_session_report(spark, sf_dir):
    """Monitoring-session report over all scored readings (the
    windowed twin is the streaming report)."""
    s = session_report(scored(spark, sf_dir))
    by_class = class_report_columns()
    return s.select(*[c for c in s.columns if c not in by_class], *[r(c).alias(c) for c in by_class])


@query("a20_pairplot_input", BASE + "SELECT reading_id, tds, turbidity, ph, quality_label FROM labelled")
def a20_pairplot_input(spark, sf_dir):
    """Pair-plot input (sensors + label) of every reading."""
    return profile.pairplot_input(labelled(spark, sf_dir))


@query("s11_sample_n", BASE + """
SELECT reading_id, tds, turbidity, ph, quality FROM labelled
ORDER BY """ + HASH_SQL + """, reading_id LIMIT 2000""")
def s11_sample_n(spark, sf_dir):
    """Exactly 2,000 rows without replacement, seed 42 (a sampling
    operator: the limit is the feature)."""
    return sample_n(labelled(spark, sf_dir).select("reading_id", "tds", "turbidity", "ph",
                                                   "quality"), 2000)


@query("p05_filter_label", BASE + "SELECT reading_id, tds, turbidity, ph FROM labelled WHERE quality_label = 'Poor'")
def p05_filter_label(spark, sf_dir):
    """P5: rows of one label."""
    return labelled(spark, sf_dir).where(F.col("quality_label") == "Poor").select(
        "reading_id", "tds", "turbidity", "ph")


@query("p06_low_confidence", CHAIN + """
SELECT reading_id, round(confidence, 6) AS confidence FROM chain WHERE confidence < 0.7e0""")
def p06_low_confidence(spark, sf_dir):
    """Low-confidence predictions (< 0.7)."""
    return scored(spark, sf_dir).where(F.col("confidence") < 0.7).select(
        "reading_id", r("confidence").alias("confidence"))


ORDERED_SQL = """
SELECT row_number() OVER (ORDER BY {order}) AS position, quality, quality_label, count(*) AS n,
       round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct
FROM labelled GROUP BY quality, quality_label ORDER BY position"""


@query("w02_report_by_class", BASE + ORDERED_SQL.format(order="quality"))
def w02_report_by_class(spark, sf_dir):
    """The class report in class order, with positions."""
    out = profile.ordered_distribution(labelled(spark, sf_dir), "class")
    return out.select("position", "quality", "quality_label", "n", r("pct").alias("pct"))


@query("w02_report_by_count", BASE + ORDERED_SQL.format(order="count(*) DESC, quality"))
def w02_report_by_count(spark, sf_dir):
    """The class report by count, largest first, with positions."""
    out = profile.ordered_distribution(labelled(spark, sf_dir), "count")
    return out.select("position", "quality", "quality_label", "n", r("pct").alias("pct"))
