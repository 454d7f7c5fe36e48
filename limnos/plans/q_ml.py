"""ML data operators, evaluation, calibration and models (M1-M8, M10-M25,
J5, A13-A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import log_probs, softmax
from ..functions.features import MODEL_FEATURES, engineer_features
from ..operators import calibrate as C
from ..operators import evaluate as EV
from ..operators import ml
from ..operators import model as MD
from ..operators.score import rule_model, score
from ..operators.standards import agency_compliance
from ..schema import label_of
from ..session import scratch_path
from ..sources.files import write_and_verify
from ..sources.samples import sample_n
from . import query
from .common import labelled, r, rounded, valid
from .q_confidence import chain_ctes
from .q_features import FEATURE_SQL
from .sql import HASH_SQL, LABEL_CASE, LABELLED, READINGS, READINGS_LINEITEM, VALID, GRADED, with_

BASE3 = ["tds", "turbidity", "ph"]


def split_sql(src: str, test: float = 0.2, val: float = 0.2) -> str:
    return f"""
, hh AS (SELECT *, {HASH_SQL} AS _h FROM {src})
, rr AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY _h, reading_id) AS _rn,
                count(*) OVER (PARTITION BY quality) AS _nc FROM hh)
, cc AS (SELECT *, CAST(floor(_nc * {test!r}e0 + 0.5e0) AS BIGINT) AS _nt FROM rr)
, dd AS (SELECT *, CAST(floor((_nc - _nt) * ({val!r}e0 / (1 - {test!r}e0)) + 0.5e0) AS BIGINT) AS _nv FROM cc)
, sp AS (SELECT * EXCLUDE (_h, _rn, _nc, _nt, _nv),
                CASE WHEN _rn <= _nt THEN 'test' WHEN _rn <= _nt + _nv THEN 'val' ELSE 'train' END AS split
         FROM dd)"""


LAB = with_(READINGS, VALID, GRADED, LABELLED)
LAB_FEAT = with_(READINGS, VALID, GRADED, LABELLED,
                 f"feat AS (SELECT *, {FEATURE_SQL} FROM labelled)")


@query("m01_stratified_split", LAB + split_sql("labelled") + """
SELECT reading_id, quality, split FROM sp""")
def m01_stratified_split(spark, sf_dir):
    """M1: exact stratified 60/20/20 split, seed 42."""
    return ml.stratified_split(labelled(spark, sf_dir)).select("reading_id", "quality", "split")


def _scaled_sql(cols):
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    sel = ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}"
                    for c in cols)
    return f"""
, st AS (SELECT {stats} FROM sp WHERE split = 'train')
SELECT reading_id, split, {sel} FROM sp, st"""


@query("m02_scale_features", LAB_FEAT + split_sql("feat") + _scaled_sql(MODEL_FEATURES))
def m02_scale_features(spark, sf_dir):
    """M2: all 35 model inputs scaled with the population std fitted on the
    training split only."""
    df = ml.stratified_split(labelled(spark, sf_dir)).transform(engineer_features)
    scaler = ml.PopulationScaler(MODEL_FEATURES).fit(df.where(F.col("split") == "train"))
    out = scaler.transform(df)
    return out.select("reading_id", "split", *rounded(MODEL_FEATURES))


@query("m03_one_hot", LAB + """
SELECT reading_id, CASE WHEN quality = 0 THEN 1e0 ELSE 0e0 END AS y_0,
       CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END AS y_1,
       CASE WHEN quality = 2 THEN 1e0 ELSE 0e0 END AS y_2,
       CASE WHEN quality = 3 THEN 1e0 ELSE 0e0 END AS y_3 FROM labelled""")
def m03_one_hot(spark, sf_dir):
    """M3: one-hot target (width = max label + 1)."""
    out = ml.one_hot(labelled(spark, sf_dir).select("reading_id", "quality"))
    return out.drop("quality")


@query("m04_class_weights", LAB + split_sql("labelled") + """
SELECT quality, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM sp WHERE split = 'train' GROUP BY quality""")
def m04_class_weights(spark, sf_dir):
    """M4: balanced class weights of the training split, keyed by class."""
    tr = ml.stratified_split(labelled(spark, sf_dir)).where(F.col("split") == "train")
    return ml.class_weights(tr).select("quality", r("weight").alias("weight"))


@query("m05_preprocess", LAB + split_sql("labelled") + """
, w AS (SELECT quality, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
        FROM sp WHERE split = 'train' GROUP BY quality)
, st AS (SELECT avg(tds) AS m_t, stddev_pop(tds) AS s_t, avg(turbidity) AS m_u,
                stddev_pop(turbidity) AS s_u, avg(ph) AS m_p, stddev_pop(ph) AS s_p
         FROM sp WHERE split = 'train')
SELECT reading_id, split, quality, round(weight, 6) AS weight, round((tds - m_t) / s_t, 6) AS tds,
       round((turbidity - m_u) / s_u, 6) AS turbidity, round((ph - m_p) / s_p, 6) AS ph
FROM sp JOIN w USING (quality), st""")
def m05_preprocess(spark, sf_dir):
    """M5: split -> scaler (train) -> class weights joined by class."""
    out, _, _ = ml.preprocess(labelled(spark, sf_dir), BASE3)
    return out.select("reading_id", "split", "quality", r("weight").alias("weight"),
                      *[r(c).alias(c) for c in BASE3])


@query("m25_transform_new_readings", LAB + split_sql("labelled") + f"""
, st AS (SELECT avg(tds) AS m_t, stddev_pop(tds) AS s_t, avg(turbidity) AS m_u,
                stddev_pop(turbidity) AS s_u, avg(ph) AS m_p, stddev_pop(ph) AS s_p
         FROM sp WHERE split = 'train')
, li AS ({READINGS_LINEITEM.split(' AS (', 1)[1].rsplit(')', 1)[0]})
SELECT reading_id, round((tds - m_t) / s_t, 6) AS tds, round((turbidity - m_u) / s_u, 6) AS turbidity,
       round((ph - m_p) / s_p, 6) AS ph
FROM li, st WHERE ph BETWEEN 4 AND 12 AND tds BETWEEN 0 AND 5000 AND turbidity BETWEEN 0 AND 100""")
def m25_transform_new_readings(spark, sf_dir):
    """New readings (lineitem) through the scaler fitted on the
    training split of events — transform only, never refit."""
    sp = ml.stratified_split(labelled(spark, sf_dir))
    scaler = ml.PopulationScaler(BASE3).fit(sp.where(F.col("split") == "train"))
    new = valid(spark, sf_dir, "lineitem").select("reading_id", *BASE3)
    return scaler.transform(new).select("reading_id", *[r(c).alias(c) for c in BASE3])


# Fixed values, written out here so that the library's own table is checked:
# pH ranges and upper limits of tds and turbidity, from excellent to acceptable.
_LIMITS = {
    "who": (((7.0, 7.5), (6.5, 8.5), (6.0, 9.0)), (300, 600, 900), (1, 4, 10)),
    "epa": (((6.8, 7.2), (6.5, 8.5), (6.0, 9.0)), (500, 1000, 1500), (1, 5, 15)),
    "canada": (((7.0, 8.0), (6.5, 8.5), (6.0, 9.0)), (200, 500, 1000), (2, 8, 20)),
}


def _band_case(agency: str) -> str:
    grades = ("excellent", "good", "acceptable")
    ph, tds, turbidity = _LIMITS[agency]
    case = lambda conds: "CASE " + " ".join(f"WHEN {c} THEN '{g}'" for c, g in zip(conds, grades)) + " ELSE 'poor' END"
    return (f"CASE parameter WHEN 'ph' THEN {case(f'value BETWEEN {lo} AND {hi}' for lo, hi in ph)} "
            f"WHEN 'tds' THEN {case(f'value <= {x}' for x in tds)} ELSE {case(f'value <= {x}' for x in turbidity)} END")


@query("j05_agency_compliance", with_(READINGS, VALID) + """
, lng AS (SELECT reading_id, 'ph' AS parameter, ph AS value FROM valid
          UNION ALL SELECT reading_id, 'tds', tds FROM valid
          UNION ALL SELECT reading_id, 'turbidity', turbidity FROM valid)
""" + "\nUNION ALL\n".join(
    f"SELECT reading_id, '{a}' AS agency, parameter, value, {_band_case(a)} AS grade FROM lng"
    for a in ("who", "epa", "canada")))
def j05_agency_compliance(spark, sf_dir):
    """Every reading graded against WHO / EPA / Canada thresholds
    (broadcast range join with the standards bands)."""
    return agency_compliance(valid(spark, sf_dir))


# -- scored calibration data: rule-model probabilities + C2 labels --------
CAL = with_(READINGS, VALID, chain_ctes("valid", more=""",
    CASE WHEN 0.4e0 * g_ph + 0.3e0 * g_tds + 0.3e0 * g_tu >= 2.5e0 THEN 3
         WHEN 0.4e0 * g_ph + 0.3e0 * g_tds + 0.3e0 * g_tu >= 1.5e0 THEN 2
         WHEN 0.4e0 * g_ph + 0.3e0 * g_tds + 0.3e0 * g_tu >= 0.5e0 THEN 1 ELSE 0 END AS quality"""),
            """cal AS MATERIALIZED (SELECT *,
    ln(least(greatest(p0, 1e-15), 1 - 1e-15)) AS z0, ln(least(greatest(p1, 1e-15), 1 - 1e-15)) AS z1,
    ln(least(greatest(p2, 1e-15), 1 - 1e-15)) AS z2, ln(least(greatest(p3, 1e-15), 1 - 1e-15)) AS z3
  FROM chain)""")


def cal_frame(spark, sf_dir):
    """Valid readings with C2 labels, rule-model probabilities and logits."""
    return (labelled(spark, sf_dir).transform(rule_model)
            .withColumn("logits", log_probs("probability")))


def _nll_sql(t: str) -> str:
    xs = [f"(z{j} / {t})" for j in range(4)]
    m = f"greatest({', '.join(xs)})"
    es = [f"exp({x} - {m})" for x in xs]
    tot = " + ".join(es)
    py = f"(CASE quality WHEN 0 THEN {es[0]} WHEN 1 THEN {es[1]} WHEN 2 THEN {es[2]} ELSE {es[3]} END) / ({tot})"
    return f"-ln(least(greatest({py}, 1e-15), 1 - 1e-15))"


@query("m10_log_probs", CAL + """
SELECT reading_id, quality, round(z0, 6) AS logit0, round(z1, 6) AS logit1, round(z2, 6) AS logit2,
       round(z3, 6) AS logit3 FROM cal""")
def m10_log_probs(spark, sf_dir):
    """log(clip(p)) of the probability row."""
    df = cal_frame(spark, sf_dir)
    return df.select("reading_id", "quality", *[r(F.col("logits")[i]).alias(f"logit{i}") for i in range(4)])


def _softmax_sql(t: str, prefix: str) -> str:
    xs = [f"(z{j} / {t})" for j in range(4)]
    m = f"greatest({', '.join(xs)})"
    es = [f"exp({x} - {m})" for x in xs]
    tot = " + ".join(es)
    return ", ".join(f"round({es[j]} / ({tot}), 6) AS {prefix}{j}" for j in range(4))


@query("m11_softmax", CAL + f"SELECT reading_id, {_softmax_sql('1e0', 'q')} FROM cal")
def m11_softmax(spark, sf_dir):
    """Stable row softmax of the logits (recovers the probabilities)."""
    df = cal_frame(spark, sf_dir).withColumn("q", softmax("logits"))
    return df.select("reading_id", *[r(F.col("q")[i]).alias(f"q{i}") for i in range(4)])


@query("m13_temperature_apply", CAL + f"SELECT reading_id, {_softmax_sql('2e0', 'q')} FROM cal")
def m13_temperature_apply(spark, sf_dir):
    """softmax(logits / T) at T = 2."""
    df = C.apply_temperature(cal_frame(spark, sf_dir), 2.0, out="q")
    return df.select("reading_id", *[r(F.col("q")[i]).alias(f"q{i}") for i in range(4)])


@query("m12_temperature_nll", CAL + f"""
, grid AS (SELECT 0.1e0 + i * 0.1e0 AS temperature FROM range(0, 100) t(i))
SELECT round(temperature, 6) AS temperature, round(sum({_nll_sql('temperature')}), 6) AS nll
FROM cal, grid GROUP BY temperature""")
def m12_temperature_nll(spark, sf_dir):
    """M12 (one grid pass): total NLL at T = 0.1 .. 10.0, one aggregation."""
    out = C.temperature_nll(cal_frame(spark, sf_dir), C.FIRST_GRID)
    return out.select(r("temperature").alias("temperature"), r("nll").alias("nll"))


def _slope_sql(u: str) -> str:
    """Loss, slope and curvature in u = 1 / T, summed over readings."""
    xs = [f"(z{j} * {u})" for j in range(4)]
    es = [f"exp({x} - greatest({', '.join(xs)}))" for x in xs]
    tot = f"({' + '.join(es)})"
    mean = f"(({' + '.join(f'{e} * z{j}' for j, e in enumerate(es))}) / {tot})"
    square = f"(({' + '.join(f'{e} * z{j} * z{j}' for j, e in enumerate(es))}) / {tot})"
    zy = "(CASE quality WHEN 0 THEN z0 WHEN 1 THEN z1 WHEN 2 THEN z2 ELSE z3 END)"
    return (f"sum(greatest({', '.join(xs)}) + ln({tot}) - {zy} * {u}) AS f, sum({mean} - {zy}) AS g, "
            f"sum({square} - {mean} * {mean}) AS h")


def _fit_sql(src: str = "cal", steps: int = 30) -> str:
    """Newton in u = 1 / T within a bracket, step by step; b3 holds the
    temperature and its loss."""
    s = f"""
, lower AS MATERIALIZED (SELECT {_slope_sql('0.1e0')} FROM {src}), upper AS MATERIALIZED (SELECT {_slope_sql('10e0')} FROM {src})
, u0 AS (SELECT 1e0 AS u, 0.1e0 AS lo, 10e0 AS hi)"""
    for i in range(steps):
        s += f"""
, n{i} AS MATERIALIZED (SELECT u, lo, hi, {_slope_sql('u')} FROM {src}, u{i} GROUP BY u, lo, hi)
, w{i} AS (SELECT u, CASE WHEN g > 0 THEN lo ELSE u END AS lo, CASE WHEN g > 0 THEN u ELSE hi END AS hi, u - g / h AS t FROM n{i})
, u{i + 1} AS MATERIALIZED (SELECT CASE WHEN t > lo AND t < hi THEN t ELSE (lo + hi) / 2 END AS u, lo, hi FROM w{i})"""
    return s + f"""
, b2 AS MATERIALIZED (SELECT CASE WHEN lower.g >= 0 THEN 0.1e0 WHEN upper.g <= 0 THEN 10e0 ELSE u END AS u FROM u{steps}, lower, upper)
, b3 AS MATERIALIZED (SELECT 1 / u AS c, f AS nll FROM (SELECT u, {_slope_sql('u')} FROM {src}, b2 GROUP BY u))"""


PLATT_STEPS = 12


def _platt_sql(src: str = "cal") -> str:
    """Newton steps of the Platt line (intercept a, slope b) on the top
    probability x and whether the true class holds it."""
    s = f"""
, xy AS MATERIALIZED (SELECT greatest(p0, p1, p2, p3) AS x, CASE WHEN CASE quality WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2
    ELSE p3 END = greatest(p0, p1, p2, p3) THEN 1e0 ELSE 0e0 END AS y FROM {src})
, a0 AS (SELECT ln(sum(y) / (count(*) - sum(y))) AS a, 0e0 AS b FROM xy)"""
    for i in range(PLATT_STEPS):
        s += f"""
, q{i} AS MATERIALIZED (SELECT a, b, sum(y - p) AS g0, sum((y - p) * x) - b AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
    sum(p * (1 - p) * x * x) + 1 AS h11 FROM (SELECT x, y, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM xy, a{i}) GROUP BY a, b)
, a{i + 1} AS MATERIALIZED (SELECT a + s0 * k AS a, b + s1 * k AS b FROM (SELECT a, b, s0, s1,
    least(1e0, 5 / greatest(1e-300, abs(s0), abs(s1))) AS k FROM (SELECT a, b, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS s0,
    (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS s1 FROM q{i})))"""
    return s + f"""
, line AS MATERIALIZED (SELECT a, b FROM a{PLATT_STEPS})"""


@query("m12_temperature_fit", CAL + _fit_sql() + """
SELECT round(c, 6) AS temperature, round(nll, 6) AS nll FROM b3""")
def m12_temperature_fit(spark, sf_dir):
    """Temperature minimising the NLL on [0.1, 10] (Newton in 1 / T)."""
    fit = C.fit_temperature(cal_frame(spark, sf_dir))
    return spark.createDataFrame([(round(fit["temperature"], 6), round(fit["nll"], 6))],
                                 "temperature double, nll double")


@query("m19_calibration_set", CAL + f"""
SELECT reading_id, quality AS label, round(z0, 6) AS logit0, round(z1, 6) AS logit1,
       round(z2, 6) AS logit2, round(z3, 6) AS logit3
FROM cal ORDER BY {HASH_SQL}, reading_id LIMIT 2000""")
def m19_calibration_set(spark, sf_dir):
    """Seeded 2,000-row calibration sample, scored raw, as logits."""
    df = sample_n(cal_frame(spark, sf_dir), 2000)
    return df.select("reading_id", F.col("quality").alias("label"),
                     *[r(F.col("logits")[i]).alias(f"logit{i}") for i in range(4)])


@query("m14_platt_fit", CAL + _platt_sql() + """
SELECT round(a, 5) AS intercept, round(b, 5) AS slope FROM line""")
def m14_platt_fit(spark, sf_dir):
    """Platt scaling (distributed Newton steps) on the calibration set;
    returns intercept and slope."""
    line = C.fit_platt(cal_frame(spark, sf_dir))
    return spark.createDataFrame([(line.intercept, line.slope)], "intercept double, slope double") \
        .select(r("intercept", 5).alias("intercept"), r("slope", 5).alias("slope"))


# the fit at a point is the largest, over its starts, of the smallest mean up to its ends
ISOTONIC = """
, pts AS (SELECT t, sum(hit) AS h, count(*) AS n
          FROM (SELECT round(greatest(p0, p1, p2, p3), 12) AS t, CASE WHEN model_class = quality THEN 1 ELSE 0 END AS hit FROM cal)
          GROUP BY t)
, sums AS MATERIALIZED (SELECT t, h, n, row_number() OVER w AS i, sum(h) OVER w AS to_h, sum(n) OVER w AS to_n
                        FROM pts WINDOW w AS (ORDER BY t))
, spans AS MATERIALIZED (SELECT a.i AS i, b.i AS j, (b.to_h - a.to_h + a.h) / CAST(b.to_n - a.to_n + a.n AS DOUBLE) AS m
                         FROM sums a JOIN sums b ON a.i <= b.i)
, least_mean AS (SELECT i, j AS k, min(m) OVER (PARTITION BY i ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM spans)
, fitted AS MATERIALIZED (SELECT k, max(m) AS f FROM least_mean GROUP BY k)
, curve AS MATERIALIZED (SELECT t, f FROM fitted JOIN sums ON i = k)"""
ISOTONIC_SQL = CAL + ISOTONIC


@query("m16_isotonic_fit", ISOTONIC_SQL + """
SELECT round(t, 6) AS boundary, round(f, 6) AS prediction FROM curve
QUALIFY lag(f) OVER (ORDER BY t) IS DISTINCT FROM f OR lead(f) OVER (ORDER BY t) IS DISTINCT FROM f""")
def m16_isotonic_fit(spark, sf_dir):
    """Isotonic regression of correctness on top probability; returns
    the fitted step function (boundaries, predictions)."""
    out = C.fit_isotonic(cal_frame(spark, sf_dir)).steps()
    return out.select(r("boundary").alias("boundary"), r("prediction").alias("prediction"))


@query("m15_calibrated_confidence", ISOTONIC_SQL + _platt_sql() + """
SELECT reading_id, round(1 / (1 + exp(-(a + b * greatest(p0, p1, p2, p3)))), 5) AS platt_confidence,
       round(f, 6) AS isotonic_confidence
FROM cal, line JOIN curve ON true WHERE t = round(greatest(p0, p1, p2, p3), 12)""")
def m15_calibrated_confidence(spark, sf_dir):
    """Platt and isotonic calibrated confidence per reading, the
    probability row unchanged (quirk Q-6)."""
    d = cal_frame(spark, sf_dir)
    out = d
    for m in ("platt", "isotonic"):
        cal = C.Calibrator(m).fit(d)
        out = cal.apply(out).withColumnRenamed("calibrated_confidence", f"{m}_confidence") \
            .drop("calibrated_probability")
    return out.select("reading_id", r("platt_confidence", 5).alias("platt_confidence"),
                      r("isotonic_confidence").alias("isotonic_confidence"))


def _top_sql(t: str) -> str:
    """The largest of softmax(logits / t)."""
    xs = [f"(z{j} / {t})" for j in range(4)]
    m = f"greatest({', '.join(xs)})"
    return f"1e0 / ({' + '.join(f'exp({x} - {m})' for x in xs)})"


@query("m20_calibration_select", CAL + split_sql("cal", 0.3, 0.0) + """
, train AS MATERIALIZED (SELECT * FROM sp WHERE split = 'train')""" + _fit_sql("train") + f"""
, held AS (SELECT avg(CASE WHEN model_class = quality THEN 1e0 ELSE 0e0 END) AS acc,
                  avg({_top_sql('c')} - greatest(p0, p1, p2, p3)) AS change, any_value(c) AS c
           FROM sp, b3 WHERE split = 'test')
, methods AS (SELECT 0 AS i, 'temperature' AS method, acc, round(change, 6) AS change, c FROM held
              UNION ALL SELECT 1, 'platt', acc, 0e0, 1e0 FROM held
              UNION ALL SELECT 2, 'isotonic', acc, 0e0, 1e0 FROM held)
SELECT method, round(acc, 6) AS original_accuracy, round(acc, 6) AS calibrated_accuracy, change AS confidence_change,
       round(acc + 0.5e0 * change, 5) AS score, round(c, 6) AS temperature,
       row_number() OVER (ORDER BY acc + 0.5e0 * change DESC, i) = 1 AS is_best FROM methods""")
def m20_calibration_select(spark, sf_dir):
    """M18 + M20: fit temperature / Platt / isotonic on a 70 % stratified
    split, score on 30 %, flag the best.  Platt and isotonic leave the
    probabilities as they are."""
    out = C.select_method(cal_frame(spark, sf_dir))
    return out.select("method", *[r(c).alias(c) for c in ("original_accuracy", "calibrated_accuracy",
                                                          "confidence_change", "temperature")],
                      r("score", 5).alias("score"), "is_best")


@query("s10_calibrator_roundtrip", CAL + _fit_sql() + f"""
SELECT reading_id, round(c, 6) AS temperature, round({_top_sql('c')}, 6) AS calibrated_confidence
FROM cal, b3""")
def s10_calibrator_roundtrip(spark, sf_dir):
    """The fitted calibrator is saved, loaded and applied to every
    reading."""
    d = cal_frame(spark, sf_dir)
    path = C.Calibrator("temperature").fit(d).save(spark, scratch_path(spark, "models", "calibrator"))
    cal = C.Calibrator.load(spark, path)
    return cal.apply(d).select("reading_id", r(F.lit(cal.temperature)).alias("temperature"),
                               r("calibrated_confidence").alias("calibrated_confidence"))


@query("m21_calibration_compare", CAL + _fit_sql() + f"""
SELECT round(avg({_top_sql('c')} - greatest(p0, p1, p2, p3)), 6) AS mean_difference, count(*) AS n
FROM cal, b3""")
def m21_calibration_compare(spark, sf_dir):
    """M21 + A19: raw vs temperature-calibrated confidence over every
    scored reading; mean paired difference."""
    from ..operators.profile import mean_paired_difference
    d = cal_frame(spark, sf_dir)
    cal = C.Calibrator("temperature").fit(d)
    out = cal.apply(d).withColumn("raw_confidence", F.array_max("probability"))
    diff = mean_paired_difference(out, "calibrated_confidence", "raw_confidence")
    return diff.select(r("mean_difference").alias("mean_difference"), "n")


@query("m17_ensemble_calibration", ISOTONIC_SQL + _platt_sql() + _fit_sql() + f"""
, soft AS (SELECT cal.*, c, {", ".join(f"exp((z{j} - greatest(z0, z1, z2, z3)) / c) AS e{j}" for j in range(4))} FROM cal, b3)
SELECT reading_id, round(0.5e0 * greatest(e0, e1, e2, e3) / (e0 + e1 + e2 + e3)
                         + 0.3e0 / (1 + exp(-(a + b * greatest(p0, p1, p2, p3)))) + 0.2e0 * f, 5) AS calibrated_confidence,
       {", ".join(f"round(0.5e0 * e{j} / (e0 + e1 + e2 + e3) + 0.5e0 * p{j}, 6) AS q{j}" for j in range(4))}
FROM soft, line, curve WHERE t = round(greatest(p0, p1, p2, p3), 12)""")
def m17_ensemble_calibration(spark, sf_dir):
    """Intended ensemble (0.5 temperature + 0.3 Platt + 0.2 isotonic)."""
    d = cal_frame(spark, sf_dir)
    cal = C.Calibrator("ensemble").fit(d)
    out = cal.apply(d)
    return out.select("reading_id", r("calibrated_confidence", 5).alias("calibrated_confidence"),
                      *[r(F.col("calibrated_probability")[i]).alias(f"q{i}") for i in range(4)])


# -- evaluation of the stand-in model against the C2 labels ---------------

EVAL = CAL + """
, ev AS (SELECT quality AS actual, model_class AS predicted FROM cal)"""


def eval_frame(spark, sf_dir):
    return cal_frame(spark, sf_dir).transform(score_probs)


def score_probs(df):
    from ..functions.arrays import argmax
    return df.withColumn("predicted", argmax("probability"))


@query("a13_confusion_matrix", EVAL + """
, cls AS (SELECT CAST(i AS INTEGER) AS actual FROM range(0, 4) t(i))
SELECT c.actual, count_if(predicted = 0) AS pred_0, count_if(predicted = 1) AS pred_1,
       count_if(predicted = 2) AS pred_2, count_if(predicted = 3) AS pred_3
FROM cls c LEFT JOIN ev USING (actual) GROUP BY c.actual""")
def a13_confusion_matrix(spark, sf_dir):
    """4 x 4 confusion matrix (zeros included)."""
    return EV.confusion_matrix(eval_frame(spark, sf_dir), "quality", "predicted")


@query("a14_accuracy", EVAL + """
SELECT round(avg(CASE WHEN actual = predicted THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS n FROM ev""")
def a14_accuracy(spark, sf_dir):
    """Accuracy."""
    a = EV.accuracy(eval_frame(spark, sf_dir), "quality", "predicted")
    return a.select(r("accuracy").alias("accuracy"), "n")


@query("a15_classification_report", EVAL + """
, cls AS (SELECT CAST(i AS INTEGER) AS c FROM range(0, 4) t(i))
, per AS (SELECT c, count_if(actual = c AND predicted = c) AS tp, count_if(actual = c) AS support,
                 count_if(predicted = c) AS pred_n FROM cls, ev GROUP BY c)
, m AS (SELECT CAST(c AS VARCHAR) AS label,
               CASE WHEN pred_n = 0 THEN 0e0 ELSE tp / pred_n END AS precision,
               CASE WHEN support = 0 THEN 0e0 ELSE tp / support END AS recall, support
        FROM per WHERE support > 0 OR pred_n > 0)
, m2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0e0
                        ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(f1, 6) AS f1 FROM m2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), sum(support), round(avg(f1), 6) FROM m2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), sum(support),
       round(sum(f1 * support) / sum(support), 6) FROM m2""")
def a15_classification_report(spark, sf_dir):
    """Precision / recall / F1 / support per class, macro and
    weighted averages."""
    rep = EV.classification_report(eval_frame(spark, sf_dir), "quality", "predicted")
    return rep.select("label", r("precision").alias("precision"), r("recall").alias("recall"),
                      F.col("support").cast("long").alias("support"), r("f1").alias("f1"))


@query("a16_per_class_accuracy", EVAL + """
, cls AS (SELECT CAST(i AS INTEGER) AS actual FROM range(0, 4) t(i))
SELECT c.actual, round(CASE WHEN count(ev.actual) = 0 THEN 0e0
                            ELSE count_if(predicted = c.actual) / count(ev.actual) END, 6) AS accuracy,
       count(ev.actual) AS support
FROM cls c LEFT JOIN ev USING (actual) GROUP BY c.actual""")
def a16_per_class_accuracy(spark, sf_dir):
    """Per-class accuracy (diagonal / row sum)."""
    p = EV.per_class_accuracy(eval_frame(spark, sf_dir), "quality", "predicted")
    return p.select("actual", r("accuracy").alias("accuracy"), "support")


# -- trained models (rows-only checks) ------------------------------------

def _splits(spark, sf_dir):
    """Raw labelled readings of the train, validation and test splits."""
    sp = ml.stratified_split(labelled(spark, sf_dir))
    return [sp.where(F.col("split") == s) for s in ("train", "val", "test")]


@query("m06_train_score")
def m06_train_score(spark, sf_dir):
    """M6 + M22: random forest on the 3 base features (class-weighted,
    scaler fitted on train), scored on the test split."""
    train, _, test = _splits(spark, sf_dir)
    out = MD.model_probabilities(MD.train(train, BASE3))(test)
    return MD.predicted_class(out).select("reading_id", "quality", "predicted",
                                          F.array_max("probability").alias("top_probability"))


@query("m06_net")
def m06_net(spark, sf_dir):
    """M6: the class-weighted softmax net on the 3 base features (gradients
    summed over partitions, early stop on the validation split), reported by
    class on the test split."""
    train, val, test = _splits(spark, sf_dir)
    model = MD.train(train, BASE3, kind="net", validation=val)
    out = MD.predicted_class(MD.model_probabilities(model)(test))
    return EV.classification_report(out, "quality", "predicted")


@query("m08_retrain_enhanced")
def m08_retrain_enhanced(spark, sf_dir):
    """M8: retrain on the 35 enhanced features, save the whole pipeline, load
    it back and score the raw readings of the test split (S9 round trip)."""
    train, _, test = _splits(spark, sf_dir)
    path = MD.save_model(MD.train(train, MODEL_FEATURES), scratch_path(spark, "models", "enhanced"))
    out = MD.model_probabilities(MD.load_model(path))(test)
    return MD.predicted_class(out).select("reading_id", "quality", "predicted")


@query("m08_spot_samples")
def m08_spot_samples(spark, sf_dir):
    """M8: the five spot readings, by the rules and by the model retrained on
    the 35 enhanced features, saved and loaded."""
    path = MD.save_model(MD.train(_splits(spark, sf_dir)[0], MODEL_FEATURES), scratch_path(spark, "models", "spot"))
    return MD.spot_samples(spark, MD.load_model(path))


@query("m22_evaluate_model")
def m22_evaluate_model(spark, sf_dir):
    """Trained model's test classification report."""
    return EV.classification_report(_tested(spark, sf_dir), "quality", "predicted")


@query("m24_model_summary")
def m24_model_summary(spark, sf_dir):
    """Trained model's test accuracy, overall and by class, with
    supports."""
    return EV.summary(_tested(spark, sf_dir), "quality", "predicted")


def _tested(spark, sf_dir):
    train, _, test = _splits(spark, sf_dir)
    return MD.predicted_class(MD.model_probabilities(MD.train(train, BASE3))(test))


@query("m07_model_quality_report")
def m07_model_quality_report(spark, sf_dir):
    """M7 with a trained model: all valid readings scored by the forest
    (features -> scaler -> model) and the confidence chain, reported per
    predicted class."""
    model = MD.train(_splits(spark, sf_dir)[0], BASE3)
    s = score(valid(spark, sf_dir), model=MD.model_probabilities(model))
    return s.groupBy("quality_label").agg(F.count(F.lit(1)).alias("n"),
                                          F.avg("confidence").alias("mean_confidence"))


# -- SMOTE (M9, J2, J6, A12) ----------------------------------------------

SMOTE_BASE = LAB + """
, cnt AS (SELECT quality, count(*) AS n FROM labelled GROUP BY quality)
, plan AS (SELECT quality, n, (SELECT max(n) FROM cnt) - n AS need FROM cnt)
, plan2 AS (SELECT *, need // n AS q, need % n AS rem FROM plan WHERE need > 0)
, pts AS (SELECT reading_id, quality, tds, turbidity, ph FROM labelled
          WHERE quality IN (SELECT quality FROM plan2))
, pairs AS (SELECT a.reading_id AS pid, a.quality, b.reading_id AS nid,
                   (a.tds - b.tds) * (a.tds - b.tds) + (a.turbidity - b.turbidity) * (a.turbidity - b.turbidity)
                   + (a.ph - b.ph) * (a.ph - b.ph) AS d2,
                   b.tds AS nn_tds, b.turbidity AS nn_turbidity, b.ph AS nn_ph
            FROM pts a JOIN pts b ON a.quality = b.quality AND a.reading_id <> b.reading_id)
, nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY pid ORDER BY d2, nid) AS INTEGER) AS rank
         FROM pairs QUALIFY rank <= 5)"""

SMOTE_SQL = SMOTE_BASE + f"""
, hh AS (SELECT p.*, {HASH_SQL} AS _h FROM pts p)
, pos AS (SELECT hh.*, row_number() OVER (PARTITION BY quality ORDER BY _h, reading_id) - 1 AS _pos FROM hh)
, cp AS (SELECT pos.*, q + CASE WHEN _pos < rem THEN 1 ELSE 0 END AS _m FROM pos JOIN plan2 USING (quality))
, syn AS (SELECT reading_id AS source_id, quality, tds, turbidity, ph, _h, unnest(range(0, _m)) AS copy
          FROM cp WHERE _m > 0)
, kb AS (SELECT pid, count(*) AS kb FROM nn GROUP BY pid)
, pk AS (SELECT s.*, coalesce(kb.kb, 0) AS k_b,
                (((_h // 2147483648) * 48271 + copy * 7919) % 2147483647)
                  % greatest(coalesce(kb.kb, 0), 1) + 1 AS _rank,
                ((((_h % 2147483648) * 16807 + copy * 104729) % 2147483647) % 1000) / 1000e0 AS lam
         FROM syn s LEFT JOIN kb ON kb.pid = s.source_id)
, smoted AS (
  SELECT source_id, CAST(copy AS INTEGER) AS copy, pk.quality,
         CASE WHEN k_b > 0 THEN pk.tds + lam * (nn.nn_tds - pk.tds) ELSE pk.tds END AS tds,
         CASE WHEN k_b > 0 THEN pk.turbidity + lam * (nn.nn_turbidity - pk.turbidity) ELSE pk.turbidity END AS turbidity,
         CASE WHEN k_b > 0 THEN pk.ph + lam * (nn.nn_ph - pk.ph) ELSE pk.ph END AS ph
  FROM pk LEFT JOIN nn ON nn.pid = pk.source_id AND nn.rank = pk._rank
  UNION ALL
  SELECT reading_id, -1, quality, tds, turbidity, ph FROM labelled)"""


def _smote_frame(spark, sf_dir):
    from ..operators.smote import smote
    return smote(labelled(spark, sf_dir).select("reading_id", "quality", *BASE3))


@query("j02_smote_neighbors", SMOTE_BASE + """
SELECT pid, quality, rank, nid, round(d2, 6) AS d2 FROM nn""")
def j02_smote_neighbors(spark, sf_dir):
    """Exact 5 nearest neighbours within each minority class (k-d
    partition, never all pairs of a class)."""
    from ..operators.smote import kept_rows, nearest_neighbors
    lab = kept_rows(labelled(spark, sf_dir))
    counts = {r[0]: r[1] for r in lab.groupBy("quality").count().collect()}
    minority = [c for c, n in counts.items() if n < max(counts.values())]
    nn = nearest_neighbors(lab, 5, classes=minority, kept=True)
    return nn.select("pid", "quality", "rank", "nid", r("d2").alias("d2"))


@query("m09_smote_resample", SMOTE_SQL + """
SELECT source_id, copy, quality, round(tds, 6) AS tds, round(turbidity, 6) AS turbidity,
       round(ph, 6) AS ph FROM smoted""")
def m09_smote_resample(spark, sf_dir):
    """M9 + J6: SMOTE (k = 5) raising every class to the majority size;
    originals (copy = -1) unioned with the synthetic rows."""
    out = _smote_frame(spark, sf_dir)
    return out.select("source_id", "copy", "quality", *[r(c).alias(c) for c in BASE3])


@query("p15_resampled_set", SMOTE_SQL + f"""
SELECT source_id, copy, quality, {LABEL_CASE.format(c='quality')} AS quality_label, round(tds, 6) AS tds,
       round(turbidity, 6) AS turbidity, round(ph, 6) AS ph FROM smoted""")
def p15_resampled_set(spark, sf_dir):
    """P15 + S5: the resampled set, synthetic rows labelled by their class,
    written, read back and verified."""
    out = _smote_frame(spark, sf_dir).withColumn("quality_label", label_of(F.col("quality")))
    back = write_and_verify(out, scratch_path(spark, "io", "resampled"), "parquet")
    return back.select("source_id", "copy", "quality", "quality_label", *[r(c).alias(c) for c in BASE3])


@query("a12_imbalance_ratio", SMOTE_SQL + """
, b AS (SELECT count(*) AS n FROM labelled GROUP BY quality)
, a AS (SELECT count(*) AS n FROM smoted GROUP BY quality)
SELECT (SELECT sum(n) FROM b) AS before_rows, (SELECT max(n) / min(n) FROM b) AS before_imbalance,
       (SELECT sum(n) FROM a) AS after_rows, (SELECT max(n) / min(n) FROM a) AS after_imbalance,
       (SELECT sum(n) FROM a) - (SELECT sum(n) FROM b) AS added_rows,
       round(((SELECT sum(n) FROM a) - (SELECT sum(n) FROM b)) * 100e0 / (SELECT sum(n) FROM b), 6) AS growth_pct""")
def a12_imbalance_ratio(spark, sf_dir):
    """Class imbalance (max / min count) and size before and after
    SMOTE."""
    from ..operators.profile import imbalance_ratio
    from ..operators.smote import kept_rows, smote
    lab = kept_rows(labelled(spark, sf_dir))
    out = imbalance_ratio(lab, smote(lab, kept=True))
    return out.select(F.col("before_rows").cast("long").alias("before_rows"), "before_imbalance",
                      F.col("after_rows").cast("long").alias("after_rows"), "after_imbalance",
                      F.col("added_rows").cast("long").alias("added_rows"),
                      r("growth_pct").alias("growth_pct"))


@query("p01_features_target", LAB_FEAT + f"""
SELECT reading_id, quality, {", ".join(c if c in ("high_risk_count", "drinking_safety_score") else f"round({c}, 6) AS {c}" for c in MODEL_FEATURES)}
FROM feat""")
def p01_features_target(spark, sf_dir):
    """The 35 model inputs (3 sensors + 32 engineered) and the target."""
    df = labelled(spark, sf_dir).transform(engineer_features)
    ints = ("high_risk_count", "drinking_safety_score")
    out = df.select("reading_id", "quality", *ints, *rounded([c for c in MODEL_FEATURES if c not in ints]))
    return out.select("reading_id", "quality", *MODEL_FEATURES)
