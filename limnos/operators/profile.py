"""Profiling aggregations.

All are ``groupBy`` aggregations with map-side partial aggregation; any
per-class dimension that is joined back (histogram ranges) has one row per
class, so broadcasting it is bounded by the class count.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import quantiles

SENSORS = ["tds", "turbidity", "ph"]


def quality_distribution(df: DataFrame, cls: str = "quality",
                         label: str = "quality_label") -> DataFrame:
    """A1 + A2: count and percent share per class (value_counts)."""
    counts = df.groupBy(cls, label).agg(F.count(F.lit(1)).alias("n"))
    # the aggregated frame has one row per class: a global window is tiny
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def ordered_distribution(df: DataFrame, by: str = "class", cls: str = "quality",
                         label: str = "quality_label") -> DataFrame:
    """A1 + A2 as a sorted report with its 1-based ``position``: ``by``
    the class, or by count, largest first (equal counts by class).  A null
    class comes first among classes; an empty table gives an empty report."""
    order = {"class": [F.col(cls), F.col(label)], "count": [F.col("n").desc(), F.col(cls), F.col(label)]}[by]
    # one row per class: the window and the sort are tiny
    return (quality_distribution(df, cls, label)
            .withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy("position"))


def class_share_all(df: DataFrame, label: str = "quality_label") -> DataFrame:
    """A2 (dashboard form): count and percent for all four labels, 0 when
    a label is absent (left join from the fixed 4-row label dimension)."""
    from ..schema import label_dim

    dim = label_dim(df.sparkSession).select(F.col("quality_label").alias(label))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return (dim.join(counts, label, "left").na.fill(0, ["n"])
            .withColumn("pct", F.coalesce(F.col("n") * 100.0 / total, F.lit(0.0))))


def mean_by_class(df: DataFrame, by: str = "quality_label", cols=SENSORS,
                  digits: int = 2) -> DataFrame:
    """A5: mean of each sensor by class, rounded."""
    return df.groupBy(by).agg(*[F.round(F.avg(c), digits).alias(f"avg_{c}") for c in cols])


def minmax_by_class(df: DataFrame, by: str = "quality", cols=SENSORS) -> DataFrame:
    """A4 (+ A11 first label, as the smallest label for determinism)."""
    aggs = [f for c in cols for f in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                              F.min("quality_label").alias("first_label"), *aggs)


def distinct_classes(df: DataFrame, cls: str = "quality") -> DataFrame:
    """A10."""
    return df.select(cls).distinct()


def describe(df: DataFrame, cols: Sequence[str] = SENSORS) -> DataFrame:
    """A3: count, mean, std (ddof 1), min, exact 25/50/75 % (linear
    interpolation, like pandas), max — one row per column.  Moments come from
    one aggregation; quartiles from ``order_stats`` (two scans)."""
    aggs = []
    for c in cols:
        x = F.when(~F.isnan(F.col(c)), F.col(c))
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
    moments = df.agg(*aggs).collect()[0]
    # all columns' quartiles at once: stack (column, value) and let the column
    # name be the group; its two scans read these columns only
    long = df.selectExpr("stack({}, {}) AS (_col, _val)".format(
        len(cols), ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)))
    n_by = {c: moments[f"{c}__count"] for c in cols}
    q = quantiles(long, "_val", [0.25, 0.5, 0.75], group="_col", n_by_group=n_by)
    rows = []
    for c in cols:
        n = n_by[c]
        rows.append((c, int(n), moments[f"{c}__mean"], moments[f"{c}__std"],
                     moments[f"{c}__min"], q.get((c, 0.25)), q.get((c, 0.5)),
                     q.get((c, 0.75)), moments[f"{c}__max"]))
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")


def null_counts(df: DataFrame) -> DataFrame:
    """NULL-or-NaN count and type per column (one aggregation)."""
    aggs = []
    for name, typ in df.dtypes:
        miss = F.col(name).isNull()
        if typ in ("double", "float"):
            miss = miss | F.isnan(name)
        aggs.append(F.sum(miss.cast("long")).alias(name))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in df.columns)
    types = F.create_map(*[x for n, t in df.dtypes for x in (F.lit(n), F.lit(t))])
    return (wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (column, null_count)")
            .withColumn("dtype", types[F.col("column")]))


def corr_matrix(df: DataFrame, cols=("tds", "turbidity", "ph", "quality")) -> DataFrame:
    """Pearson correlation of every ordered pair, one aggregation."""
    cols = list(cols)
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
            for a in cols for b in cols]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a in cols for b in cols)
    return wide.selectExpr(f"stack({len(cols) ** 2}, {pairs}) as (col_a, col_b, corr)")


def histogram_by_class(df: DataFrame, value: str, by: str, bins: int = 30) -> DataFrame:
    """``bins`` equal-width bins over each class's own min..max,
    last bin closed (numpy semantics, a zero-width range becomes
    [v - .5, v + .5]); empty bins are reported with 0."""
    ranges = (df.groupBy(by).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
              .withColumn("_lo", F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5)
                          .otherwise(F.col("_mn")))
              .withColumn("_hi", F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5)
                          .otherwise(F.col("_mx"))))
    # one row per class: bounded, broadcast
    b = F.least(F.floor((F.col(value) - F.col("_lo")) * (bins / (F.col("_hi") - F.col("_lo")))),
                F.lit(bins - 1)).cast("int")
    counts = (df.select(by, value).join(F.broadcast(ranges), by)
              .groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    grid = ranges.select(by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (grid.join(counts, [by, "bin"], "left")
            .select(by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def imbalance_ratio(before: DataFrame, after: DataFrame, cls: str = "quality") -> DataFrame:
    """max/min class-count ratio before and after, sizes and % growth
    (one tagged aggregation; no join)."""
    tagged = (before.select(cls, F.lit("before").alias("_tag"))
              .unionByName(after.select(cls, F.lit("after").alias("_tag"))))
    c = tagged.groupBy("_tag", cls).agg(F.count(F.lit(1)).alias("n"))

    def pick(tag, fn):
        return fn(F.when(F.col("_tag") == tag, F.col("n")))

    out = c.agg(pick("before", F.sum).alias("before_rows"),
                (pick("before", F.max) / pick("before", F.min)).alias("before_imbalance"),
                pick("after", F.sum).alias("after_rows"),
                (pick("after", F.max) / pick("after", F.min)).alias("after_imbalance"))
    return (out.withColumn("added_rows", F.col("after_rows") - F.col("before_rows"))
            .withColumn("growth_pct", F.col("added_rows") * 100.0 / F.col("before_rows")))


def confidence_stats(df: DataFrame, conf: str = "confidence", high: float = 0.9) -> DataFrame:
    """Mean confidence and % of rows above ``high``."""
    return df.agg(F.avg(conf).alias("mean_confidence"),
                  (F.avg((F.col(conf) > high).cast("double")) * 100).alias("pct_high"))


def mean_paired_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """A19."""
    return df.agg(F.avg(F.col(a) - F.col(b)).alias("mean_difference"),
                  F.count(F.lit(1)).alias("n"))


def pairplot_input(df: DataFrame, n: int | None = None, key: str = "reading_id") -> DataFrame:
    """The pair-plot columns plus label (optionally a seeded sample)."""
    from ..sources.samples import sample_n

    out = df.select(key, "tds", "turbidity", "ph", "quality_label")
    return sample_n(out, n, key) if n else out
