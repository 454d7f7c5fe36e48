"""Exact order statistics without sorting a whole group in one task.

Two scans of the input, whatever its range: the first keeps a mergeable
quantile sketch per group (``GRID`` + 1 values, rank error ``1 / ACCURACY``)
with its exact count and ends; the sketch brackets every rank asked for.  The
second scan counts what lies below each bracket and how often each value
inside it occurs (pre-aggregated in each task, so a hot value holding a third
of the rows is one row).  Those counts, a few thousandths of the distinct
values, are checkpointed; up to ``DIRECT`` of them the driver walks them,
else histogram bisection goes on over them alone.  A bracket that missed its
rank (it can't by the sketch's bound, but is checked) is widened to the
group's ends.

Integers are compared as integers (exact over the whole bigint range), other
values as doubles; infinities are ranked at the two ends.
"""

from __future__ import annotations

import math
from decimal import Decimal
from typing import Dict, Hashable, List, Tuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

GRID = 1024
ACCURACY = 10_000
DIRECT = 1 << 16
BUCKETS = 2048
MAX_PASSES = 200  # a pass cuts an interval by BUCKETS: 2^64 values need 6, doubles of all scales about 100


def order_statistics(df: DataFrame, value: str, targets: Dict[Hashable, Tuple[object, int]],
                     group: str | None = None, direct: int = DIRECT) -> Dict[Hashable, float]:
    """``targets``: id -> (group value or None, 0-based rank).  Returns
    id -> value (an int for integer columns).  NULL / NaN values are ignored;
    groups without values have no result.  Raises if a rank is out of range
    or the search does not end."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    kind, number, back = ("decimal(20,0)", int, Decimal) if whole else ("double", float, float)
    x = F.col(value).cast(kind)
    base = df.select(*([F.col(group).alias("_g")] if group else [F.lit(0).alias("_g")]),
                     x.alias("_x")).where(F.col("_x").isNotNull() & (F.lit(True) if whole else ~F.isnan("_x")))
    wanted = {t: (0 if g is None else g, int(rank)) for t, (g, rank) in targets.items()}
    if not wanted:
        return {}
    grid = F.percentile_approx(F.col("_x").cast("double"), [i / GRID for i in range(GRID + 1)], ACCURACY)
    sketch = {r["_g"]: r for r in
              base.where(F.col("_g").isin(sorted({g for g, _ in wanted.values()}, key=repr))).groupBy("_g")
              .agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), grid.alias("grid")).collect()}
    wanted = {t: w for t, w in wanted.items() if w[0] in sketch}
    brackets = {}
    for t, (g, rank) in wanted.items():
        r = sketch[g]
        if not 0 <= rank < r["n"]:
            raise ValueError(f"rank {rank} out of range for target {t!r}")
        first, last = rank * GRID // r["n"] - 1, -(-(rank + 1) * GRID // r["n"]) + 1
        lo = number(r["lo"]) if first <= 0 else _below(r["grid"][first], number)
        hi = number(r["hi"]) if last >= GRID else _above(r["grid"][last], number)
        brackets[t] = (g, lo, hi)
    result, missed = _inside(base, wanted, brackets, kind, number, back, direct)
    if missed:
        ends = {t: (g, number(sketch[g]["lo"]), number(sketch[g]["hi"])) for t, (g, _) in wanted.items() if t in missed}
        more, _ = _inside(base, {t: wanted[t] for t in missed}, ends, kind, number, back, direct)
        result.update(more)
    return result


def _below(v: float, number):
    """A sketch value as a lower bound: big integers were rounded to doubles in it."""
    return v if number is float else math.floor(math.nextafter(v, -math.inf))


def _above(v: float, number):
    return v if number is float else math.ceil(math.nextafter(v, math.inf))


def _inside(base: DataFrame, wanted, brackets, kind: str, number, back, direct: int):
    """The second scan: (results, targets whose rank is not in their bracket)."""
    spark = base.sparkSession
    numbered = {b: i for i, b in enumerate(dict.fromkeys(brackets.values()))}
    # a row per bracket (groups x ranks at most): broadcast
    asked = F.broadcast(spark.createDataFrame([(i, g, back(lo), back(hi)) for (g, lo, hi), i in numbered.items()],
                                              f"_t int, _g {dict(base.dtypes)['_g']}, _lo {kind}, _hi {kind}"))
    counts = (base.join(asked, "_g").where(F.col("_x") <= F.col("_hi"))
              .groupBy("_t", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_x"))
              .agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True))
    below = {r["_t"]: r["_n"] for r in counts.where(F.col("_x").isNull()).collect()}     # a row per bracket
    held = counts.where(F.col("_x").isNotNull())
    total = {r["_t"]: r["_n"] for r in held.groupBy("_t").agg(F.sum("_n").alias("_n")).collect()}
    state, missed = {}, []
    for t, (_, rank) in wanted.items():
        i = numbered[brackets[t]]
        left = rank - below.get(i, 0)
        if 0 <= left < total.get(i, 0):
            state[t] = (i, left)
        else:
            missed.append(t)
    if held.count() > direct:
        return _bisect(held, state, kind, number, back), missed
    values: Dict[int, List] = {}
    for r in held.collect():                             # ``direct`` rows at most
        values.setdefault(r["_t"], []).append((number(r["_x"]), r["_n"]))
    result = {}
    for i, rows in values.items():
        rows.sort()
        mine = sorted((left, t) for t, (j, left) in state.items() if j == i)
        at, seen = 0, 0
        for left, t in mine:
            while seen + rows[at][1] <= left:
                seen, at = seen + rows[at][1], at + 1
            result[t] = rows[at][0]
    return result, missed


def _bisect(held: DataFrame, state, kind: str, number, back) -> Dict[Hashable, float]:
    """Values at ranks among counted values (bracket, value, count): each pass
    narrows every target's interval to one bucket's [min, max]."""
    spark = held.sparkSession
    whole = number is int
    inf = F.lit(float("inf"))
    finite = F.col("_x") if whole else F.when(F.abs("_x") < inf, F.col("_x"))
    low = F.lit(0) if whole else F.sum(F.when(F.col("_x") == -inf, F.col("_n")).otherwise(0))
    high = F.lit(0) if whole else F.sum(F.when(F.col("_x") == inf, F.col("_n")).otherwise(0))
    ends = {r["_t"]: r for r in held.groupBy("_t").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), low.alias("low"),
                                                       high.alias("high"), F.sum("_n").alias("n")).collect()}
    result, open_t = {}, {}
    for t, (i, rank) in state.items():
        e = ends[i]
        if rank < e["low"] or rank >= e["n"] - e["high"]:
            result[t] = -math.inf if rank < e["low"] else math.inf
        else:
            open_t[t] = (i, rank - e["low"], number(e["lo"]), number(e["hi"]))
    for _ in range(MAX_PASSES):
        for t in [t for t, (_, _, lo, hi) in open_t.items() if lo == hi]:
            result[t] = open_t.pop(t)[2]
        if not open_t:
            return result
        spans = {s: j for j, s in enumerate(dict.fromkeys((i, lo, hi) for i, _, lo, hi in open_t.values()))}
        tdf = F.broadcast(spark.createDataFrame([(j, i, back(lo), back(hi)) for (i, lo, hi), j in spans.items()],
                                                f"_s int, _t int, _lo {kind}, _hi {kind}"))
        # integers: whole buckets; doubles: halves of the span, which may itself exceed the largest double
        place = (F.call_function("div", F.col("_x") - F.col("_lo"), F.call_function("div", F.col("_hi") - F.col("_lo"), F.lit(BUCKETS)) + 1)
                 if whole else F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * BUCKETS))
        hist = (held.join(tdf, "_t").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
                .groupBy("_s", F.least(place, F.lit(BUCKETS - 1)).alias("_b"))
                .agg(F.sum("_n").alias("n"), F.min("_x").alias("mn"), F.max("_x").alias("mx")).collect())
        by_span: Dict[int, List] = {}
        for row in sorted(hist, key=lambda z: z["_b"]):
            by_span.setdefault(row["_s"], []).append(row)
        for t, (i, rank, lo, hi) in list(open_t.items()):
            for row in by_span[spans[(i, lo, hi)]]:
                if rank < row["n"]:
                    open_t[t] = (i, rank, number(row["mn"]), number(row["mx"]))
                    break
                rank -= row["n"]
    raise RuntimeError(f"order statistics did not end in {MAX_PASSES} passes")


def group_counts(df: DataFrame, group: str | None = None) -> Dict[Hashable, int]:
    if group is None:
        return {None: df.count()}
    return {r[0]: r[1] for r in df.groupBy(group).count().collect()}


def quantiles(df: DataFrame, value: str, probs, group: str | None = None,
              n_by_group: Dict[Hashable, int] | None = None) -> Dict[Tuple[Hashable, float], float]:
    """Exact linear-interpolation quantiles (pandas ``describe`` /
    SQL ``quantile_cont``), per group if given."""
    if n_by_group is None:
        clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        n_by_group = group_counts(clean, group)
    targets = {}
    for g, n in n_by_group.items():
        if not n:
            continue
        for q in probs:
            pos = q * (n - 1)
            lo = int(pos // 1)
            targets[(g, lo)] = (g, lo)
            targets[(g, min(lo + 1, n - 1))] = (g, min(lo + 1, n - 1))
    vals = order_statistics(df, value, targets, group)
    out = {}
    for g, n in n_by_group.items():
        if not n:
            continue
        for q in probs:
            pos = q * (n - 1)
            lo = int(pos // 1)
            hi = min(lo + 1, n - 1)
            a, b = vals[(g, lo)], vals[(g, hi)]
            out[(g, q)] = a if a == b else a + (b - a) * (pos - lo)
    return out
