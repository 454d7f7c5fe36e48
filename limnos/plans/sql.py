"""SQL text shared by the DuckDB oracles.  Written independently of the
Spark column builders: the oracles restate each rule as plain CASE / math
SQL over the same driver tables."""

READINGS = """readings AS (
  SELECT event_id AS reading_id, user_id AS sensor_id, event_type AS site, ts,
         round(value * 12e0, 2) AS tds,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 4e0 AS turbidity,
         (35 + (event_id * 13) % 36 + (user_id * 7) % 36) / 10e0 AS ph
  FROM events)"""

READINGS_LINEITEM = """readings AS (
  SELECT l_orderkey * 8 + l_linenumber AS reading_id, l_suppkey AS sensor_id,
         l_returnflag || l_linestatus AS site, l_shipdate AS ts,
         floor(l_extendedprice / 20e0) AS tds,
         l_quantity / 2e0 AS turbidity,
         (35 + l_partkey % 71) / 10e0 AS ph
  FROM lineitem)"""

VALID_WHERE = ("ph BETWEEN 4 AND 12 AND tds BETWEEN 0 AND 5000 "
               "AND turbidity BETWEEN 0 AND 100")

G_PH = ("CASE WHEN ph BETWEEN 7.0 AND 7.5 THEN 3 WHEN ph BETWEEN 6.5 AND 8.5 THEN 2 "
        "WHEN ph BETWEEN 6.0 AND 9.0 THEN 1 ELSE 0 END")
G_TDS = "CASE WHEN tds <= 300 THEN 3 WHEN tds <= 600 THEN 2 WHEN tds <= 900 THEN 1 ELSE 0 END"
G_TU = ("CASE WHEN turbidity <= 1 THEN 3 WHEN turbidity <= 4 THEN 2 "
        "WHEN turbidity <= 10 THEN 1 ELSE 0 END")

LABEL_CASE = ("CASE {c} WHEN 0 THEN 'Poor' WHEN 1 THEN 'Acceptable' WHEN 2 THEN 'Good' "
              "WHEN 3 THEN 'Excellent' END")

VALID = f"""valid AS (SELECT * FROM readings WHERE {VALID_WHERE})"""

GRADED = f"""graded AS (
  SELECT *, {G_PH} AS g_ph, {G_TDS} AS g_tds, {G_TU} AS g_tu FROM valid)"""

LABELLED = f"""labelled AS (
  SELECT *, {LABEL_CASE.format(c='quality')} AS quality_label FROM (
    SELECT *, CASE WHEN 0.4e0 * g_ph + 0.3e0 * g_tds + 0.3e0 * g_tu >= 2.5e0 THEN 3
                   WHEN 0.4e0 * g_ph + 0.3e0 * g_tds + 0.3e0 * g_tu >= 1.5e0 THEN 2
                   WHEN 0.4e0 * g_ph + 0.3e0 * g_tds + 0.3e0 * g_tu >= 0.5e0 THEN 1
                   ELSE 0 END AS quality
    FROM graded))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def hash_sql(key: str = "reading_id", seed: int = 42) -> str:
    """The library's seeded row hash for non-negative integer keys."""
    m = 2147483647
    first = f"(({key} % {m}) * {pow(48271, 2 * seed + 1, m)} + {seed % m}) % {m}"
    high = f"((({first}) * ({first}) + {key} // {m}) % {m})"
    low = f"(({high} * {pow(69621, 2 * seed + 3, m)} + ({first})) % {m})"
    return f"({high} * 2147483648 + {low})"


HASH_SQL = hash_sql()

BASE = with_(READINGS, VALID, GRADED, LABELLED)


def py_round_sql(x: str, digits: int) -> str:
    """Python ``round(x, n)`` on the exact binary value, in SQL: the exact
    product x * 10^n is p + err (Veltkamp split); ties go to even."""
    s = f"{float(10 ** digits)!r}e0" if "e" not in repr(float(10 ** digits)) else repr(float(10 ** digits))
    p = f"(({x}) * {s})"
    sp = f"(({x}) * 134217729e0)"
    hi = f"({sp} - ({sp} - ({x})))"
    lo = f"(({x}) - {hi})"
    err = f"(({hi} * {s} - {p}) + {lo} * {s})"
    k = f"floor({p})"
    f = f"({p} - {k})"
    return (f"(({k} + CASE WHEN {f} > 0.5e0 OR ({f} = 0.5e0 AND ({err} > 0 OR ({err} = 0 "
            f"AND abs({k}) % 2 = 1))) THEN 1 ELSE 0 END) / {s})")
