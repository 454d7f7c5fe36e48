"""Validation and error routing.

Errors are values in a column, never exceptions: one projection handles a
whole batch, and the same code runs in streaming plans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col, pystr

# Physical bounds of the readings.
PH_RANGE = (4.0, 12.0)
TDS_RANGE = (0.0, 5000.0)
TURBIDITY_RANGE = (0.0, 100.0)


def first_error(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """First violated bound in the order pH, TDS, turbidity; NULL if the
    reading is valid.  NULL and NaN fail (quirk Q-13)."""
    t, u, p = col(tds), col(turbidity), col(ph)

    def bad(x, lo, hi):
        return x.isNull() | F.isnan(x) | ~x.between(lo, hi)

    return (F.when(bad(p, *PH_RANGE), F.concat(F.lit("pH value "), pystr(p),
                                               F.lit(" is outside valid range (4.0-12.0)")))
            .when(bad(t, *TDS_RANGE), F.concat(F.lit("TDS value "), pystr(t),
                                               F.lit(" is outside valid range (0-5000 mg/L)")))
            .when(bad(u, *TURBIDITY_RANGE), F.concat(F.lit("Turbidity value "), pystr(u),
                                                     F.lit(" is outside valid range (0-100 NTU)"))))


def is_valid(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    """Boolean twin of ``first_error().isNull()`` (no message text is
    built, so filters stay small in generated code)."""
    def ok(x, lo, hi):
        return x.isNotNull() & ~F.isnan(x) & x.between(lo, hi)

    return ok(col(ph), *PH_RANGE) & ok(col(tds), *TDS_RANGE) & ok(col(turbidity), *TURBIDITY_RANGE)


def _present(x: Column) -> Column:
    """P3 skips missing values; NaN counts as missing (Q-13)."""
    return x.isNotNull() & ~F.isnan(x)


def validation_errors(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    t, u, p = col(tds), col(turbidity), col(ph)
    arr = F.array(
        F.when(_present(p) & ((p < 4.0) | (p > 12.0)),
               F.concat(F.lit("pH "), pystr(p), F.lit(" is outside realistic range (4.0-12.0)"))),
        F.when(_present(t) & ((t < 0) | (t > 5000)),
               F.concat(F.lit("TDS "), pystr(t), F.lit(" mg/L is outside realistic range (0-5000)"))),
        F.when(_present(u) & ((u < 0) | (u > 100)),
               F.concat(F.lit("Turbidity "), pystr(u),
                        F.lit(" NTU is outside realistic range (0-100)"))))
    return F.filter(arr, lambda x: x.isNotNull())


def validation_warnings(tds="tds", turbidity="turbidity", ph="ph") -> Column:
    t, u, p = col(tds), col(turbidity), col(ph)
    arr = F.array(
        F.when(_present(p) & p.between(4.0, 12.0) & ((p < 6.0) | (p > 9.0)),
               F.concat(F.lit("pH "), pystr(p),
                        F.lit(" is outside typical drinking water range (6.0-9.0)"))),
        F.when(_present(t) & t.between(0, 5000) & (t > 1000),
               F.concat(F.lit("TDS "), pystr(t), F.lit(" mg/L is high for drinking water"))),
        F.when(_present(u) & u.between(0, 100) & (u > 10),
               F.concat(F.lit("Turbidity "), pystr(u), F.lit(" NTU is high for drinking water"))))
    return F.filter(arr, lambda x: x.isNotNull())


def validate(df: DataFrame, tds="tds", turbidity="turbidity", ph="ph") -> DataFrame:
    """Append ``valid``, ``errors``, ``warnings``."""
    return (df.withColumn("errors", validation_errors(tds, turbidity, ph))
            .withColumn("warnings", validation_warnings(tds, turbidity, ph))
            .withColumn("valid", F.size("errors") == 0))


def with_first_error(df: DataFrame) -> DataFrame:
    return df.withColumn("error", first_error())


def valid_readings(df: DataFrame) -> DataFrame:
    """Keep rows that pass the hard range check."""
    return df.where(is_valid())


def bounds_filter(df: DataFrame) -> DataFrame:
    """The service-edge bounds (tds 0-5000, turbidity 0-100, pH 4-12)."""
    return df.where(F.col("tds").between(*TDS_RANGE) & F.col("turbidity").between(*TURBIDITY_RANGE)
                    & F.col("ph").between(*PH_RANGE))


def clip_readings(df: DataFrame) -> DataFrame:
    """Clip each sensor to its physical range."""
    out = df
    for c, (lo, hi) in (("tds", TDS_RANGE), ("turbidity", TURBIDITY_RANGE), ("ph", PH_RANGE)):
        out = out.withColumn(c, F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))
    return out


def round_readings(df: DataFrame, digits: int = 2, half_even: bool = True) -> DataFrame:
    """Round sensors; ``bround`` matches Python's half-to-even."""
    fn = F.bround if half_even else F.round
    return df.select(*[fn(F.col(c), digits).alias(c) if c in ("tds", "turbidity", "ph") else c
                       for c in df.columns])


def _key_positions(keys: DataFrame):
    """(distinct keys with ``_first``, the 0-based position of their first
    row, and ``_n`` rows; whether every key has one row).  Only keys are
    sorted and written: a range-partitioned sort puts ascending key ranges in
    ascending partitions, a row per partition gives its offset."""
    order = keys.columns
    placed = (keys.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).orderBy(*order)
              .withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
              .withColumn("_pid", F.shiftright("_mid", 33)))
    counts = placed.groupBy("_pid").agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"))
    unique = (counts.agg(F.max("_most")).first()[0] or 1) == 1
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    placed = placed.join(F.broadcast(offsets), "_pid")
    if unique:
        within = F.col("_mid") - F.shiftleft("_pid", 33)
    else:
        within = F.sum("_n").over(Window.partitionBy("_pid").orderBy("_mid")) - F.col("_n")
    return placed.select(*order, "_n", (F.col("_off") + within).alias("_first")), unique


def with_row_index(df: DataFrame, order_cols, name: str = "row_index", base: int = 0) -> DataFrame:
    """P10: dense 0-/1-based position in ``order_cols`` order (nulls first),
    computed without funnelling rows through one task.

    Positions are found on the keys alone and joined back, so whole rows are
    shuffled once and never written; ``df`` is read twice and must give the
    same rows both times.  Rows of equal keys are ordered by a hash of the
    row, so reruns agree but for which of two equal rows comes first.  No
    rows give no rows; a column called ``name`` is replaced.
    """
    from ..session import checkpoint_dir

    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    checkpoint_dir(df.sparkSession)
    columns = [c for c in df.columns if c != name]
    keyed = df.withColumns({f"_o{i}": F.col(c) for i, c in enumerate(order_cols)})
    on = [f"_o{i}" for i in range(len(order_cols))]
    placed, unique = _key_positions(keyed.select(*on))
    if not unique:
        # the hash splits a key that many rows hold
        whole = [f.name for f in df.schema if f.name != name and "map<" not in f.dataType.simpleString()]
        keyed, on = keyed.withColumn("_oh", F.xxhash64(*whole)), [*on, "_oh"]
        placed, unique = _key_positions(keyed.select(*on))
    theirs = placed.withColumnsRenamed({c: f"_p{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in on])
    out = keyed.join(theirs, same)
    place = F.col("_first")
    if not unique:
        place = place + F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(0))) - 1
    return out.withColumn("_place", (place + base).cast("long")).select(*columns, F.col("_place").alias(name))


def batch_error_records(df: DataFrame, key: str = "reading_id") -> DataFrame:
    """Every row becomes a record with a 0-based ``sample_index``;
    invalid rows carry ``error`` (all validation errors joined) and no
    result; ``warnings`` only where non-empty."""
    v = validate(df)
    v = with_row_index(v, key, "sample_index", 0)
    return v.select(
        "*",
        F.when(~F.col("valid"), F.array_join("errors", "; ")).alias("error"),
        F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings_or_null"),
    )


def batch_drop_errors(df: DataFrame) -> DataFrame:
    """Silently drop failing rows."""
    return df.where(is_valid())
