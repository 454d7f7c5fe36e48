"""Column builders.  Every function returns a ``Column`` made only of
built-in expressions, so whole projections stay in whole-stage codegen and
behave identically in batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystr(c) -> Column:
    """Text form of a double the way Python prints it in an f-string
    (``7.2``, ``250.0``; ``nan`` / ``None`` for NaN / NULL)."""
    c = col(c)
    return (F.when(c.isNull(), F.lit("None"))
            .when(F.isnan(c), F.lit("nan"))
            .otherwise(c.cast("string")))


def pct(c, digits: int) -> Column:
    """Python ``{x:.N%}`` formatting: x * 100 in double, then rounded on the
    exact binary value (``py_round``) before Java's formatter sees it."""
    return F.format_string(f"%.{digits}f%%", py_round(col(c) * 100.0, digits))


def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi)))


def py_round(c, digits: int) -> Column:
    """Python's ``round(x, n)``: correctly rounded on the exact binary value,
    half to even on exact ties.  Spark's ``round`` is half-up on the shortest
    decimal form (quirk Q-12: ``round(67.865, 2)`` is 67.86 in Python, 67.87
    in Spark).  The exact product x * 10^n is p + err (Veltkamp split, an
    error-free transformation in plain double arithmetic)."""
    x = col(c)
    scale = float(10 ** digits)
    p = x * scale
    split = x * 134217729.0
    x_hi = split - (split - x)
    x_lo = x - x_hi
    err = (x_hi * scale - p) + x_lo * scale
    k = F.floor(p)
    f = p - k
    up = (f > 0.5) | ((f == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(k, F.lit(2)) == 1))))
    out = (k + up.cast("long")) / scale
    return F.when(x.isNull() | F.isnan(x), x).otherwise(out)
