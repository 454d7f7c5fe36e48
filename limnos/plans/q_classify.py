"""Slice 1: labelling and class-level profiles (C1, C2, P7, A1, A2, A4, A5,
A10, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grades import ph_grade, tds_grade, turbidity_grade
from ..operators import profile
from . import query
from .common import labelled, r
from .sql import BASE, LABEL_CASE


@query("c01_parameter_grades", BASE + """
SELECT reading_id, g_ph AS ph_grade, g_tds AS tds_grade, g_tu AS turbidity_grade FROM graded""")
def c01_parameter_grades(spark, sf_dir):
    """Per-parameter 0-3 grades of every valid reading."""
    return labelled(spark, sf_dir).select(
        "reading_id", ph_grade().alias("ph_grade"), tds_grade().alias("tds_grade"),
        turbidity_grade().alias("turbidity_grade"))


@query("c02_quality_class", BASE + """
SELECT reading_id, tds, turbidity, ph, quality, quality_label FROM labelled""")
def c02_quality_class(spark, sf_dir):
    """C2 + P7: weighted quality class and its label."""
    return labelled(spark, sf_dir).select("reading_id", "tds", "turbidity", "ph", "quality",
                                          "quality_label")


@query("a01_quality_distribution", BASE + """
SELECT quality, quality_label, count(*) AS n,
       round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct
FROM labelled GROUP BY quality, quality_label""")
def a01_quality_distribution(spark, sf_dir):
    """A1 + A2: value counts and percent share of each class."""
    return (profile.quality_distribution(labelled(spark, sf_dir))
            .select("quality", "quality_label", "n", r("pct").alias("pct")))


@query("a02_class_share_all", BASE + """
, labels AS (SELECT * FROM (VALUES ('Poor'), ('Acceptable'), ('Good'), ('Excellent')) t(quality_label))
, counts AS (SELECT quality_label, count(*) AS n FROM labelled GROUP BY quality_label)
SELECT l.quality_label, coalesce(c.n, 0) AS n,
       round(coalesce(c.n, 0) * 100e0 / (SELECT count(*) FROM labelled), 6) AS pct
FROM labels l LEFT JOIN counts c USING (quality_label)""")
def a02_class_share_all(spark, sf_dir):
    """A2 (dashboard): all four labels with 0 for absent ones."""
    return (profile.class_share_all(labelled(spark, sf_dir))
            .select("quality_label", "n", r("pct").alias("pct")))


@query("a05_mean_by_quality", BASE + """
SELECT quality_label, round(avg(tds), 2) AS avg_tds, round(avg(turbidity), 2) AS avg_turbidity,
       round(avg(ph), 2) AS avg_ph
FROM labelled GROUP BY quality_label""")
def a05_mean_by_quality(spark, sf_dir):
    """A5: mean sensors by class, 2 dp."""
    return profile.mean_by_class(labelled(spark, sf_dir))


@query("a04_minmax_by_quality", BASE + """
SELECT quality, count(*) AS n, min(quality_label) AS first_label,
       min(tds) AS min_tds, max(tds) AS max_tds, min(turbidity) AS min_turbidity,
       max(turbidity) AS max_turbidity, min(ph) AS min_ph, max(ph) AS max_ph
FROM labelled GROUP BY quality""")
def a04_minmax_by_quality(spark, sf_dir):
    """A4 + A11: min / max per class and per sensor, first label per class."""
    return profile.minmax_by_class(labelled(spark, sf_dir))


@query("a10_distinct_classes", BASE + "SELECT DISTINCT quality FROM labelled")
def a10_distinct_classes(spark, sf_dir):
    """A10."""
    return profile.distinct_classes(labelled(spark, sf_dir))


@query("p07_label_lookup_join", BASE + f"""
SELECT reading_id, quality, {LABEL_CASE.format(c='quality')} AS label FROM labelled""")
def p07_label_lookup_join(spark, sf_dir):
    """P7 / J1, data-derived form: the class -> label map is taken from the
    data itself (distinct pairs, one per class: bounded, broadcast)."""
    lab = labelled(spark, sf_dir)
    dim = lab.select("quality", "quality_label").distinct().withColumnRenamed(
        "quality_label", "label")
    return lab.select("reading_id", "quality").join(F.broadcast(dim), "quality")
