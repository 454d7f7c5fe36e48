"""Row-local operators on hand-computed fixture rows and threshold values."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from limnos.functions import py_round
from limnos.functions.features import ENGINEERED_FEATURES, engineer_features, feature_columns
from limnos.functions.grades import (ph_grade, ph_grade_fine, quality_class, rule_class, tds_grade,
                                     turbidity_grade)
from limnos.functions.indices import (demo_class, demo_confidence, demo_score, wqi_service,
                                      wqi_simple)
from limnos.operators.score import label_readings, rule_model, enhance, prediction_record
from limnos.operators.validate import first_error, is_valid, validate
from limnos.plans.common import r


def one(df, *cols):
    return df.select(*cols).collect()


def test_preprocessor_fixture_classes(spark):
    # (tds, turbidity, ph) -> class, the reference's unit-test rows
    data = [(250.0, 0.5, 7.2, 3), (500.0, 2.0, 7.0, 2), (800.0, 5.0, 6.8, 1), (1200.0, 15.0, 5.5, 0)]
    df = rows(spark, data, "tds double, turbidity double, ph double, expected int")
    got = df.select(quality_class().alias("q"), "expected").collect()
    assert [g.q for g in got] == [g.expected for g in got]


def test_hand_checked_row(spark):
    df = engineer_features(rows(spark, [(250.0, 0.8, 7.2)]))
    row = df.first()
    assert row.who_ph_index == row.who_tds_index == row.who_turbidity_index == 100.0
    assert row.ccme_wqi == 100.0
    assert row.cpi == pytest.approx(100 * (0.5 * 250 / 2000 + 0.2 * 0.8 / 50))
    assert row.cpi == pytest.approx(6.57)
    w = rows(spark, [(250.0, 0.8, 7.2)]).select(wqi_simple().alias("w"), demo_score().alias("s")).first()
    assert w.w == pytest.approx(0.4 * 96 + 0.3 * 75 + 0.3 * 92)
    assert w.s == 100


def test_feature_count_and_order(spark):
    df = engineer_features(rows(spark, [(250.0, 0.8, 7.2)]))
    assert df.columns[3:] == ENGINEERED_FEATURES
    assert len(ENGINEERED_FEATURES) == 32
    # staged projections give the same values as the single-expression builders
    flat = rows(spark, [(975.0, 8.13, 4.0), (1500.0, 20.0, 5.0), (30.0, 0.1, 9.6)]).select(
        *[c.alias(n) for n, c in feature_columns().items()]).collect()
    staged = engineer_features(rows(spark, [(975.0, 8.13, 4.0), (1500.0, 20.0, 5.0),
                                            (30.0, 0.1, 9.6)])).collect()
    for a, b in zip(flat, staged):
        for n in ENGINEERED_FEATURES:
            assert a[n] == pytest.approx(b[n], rel=1e-12, abs=1e-12), n


@pytest.mark.parametrize("ph,expected", [
    (4.0, 0), (5.99, 0), (6.0, 1), (6.49, 1), (6.5, 2), (6.99, 2), (7.0, 3), (7.25, 3), (7.5, 3),
    (7.51, 2), (8.5, 2), (8.51, 1), (9.0, 1), (9.01, 0), (12.0, 0)])
def test_ph_grade_boundaries(spark, ph, expected):
    assert rows(spark, [(0.0, 0.0, ph)]).select(ph_grade()).first()[0] == expected


@pytest.mark.parametrize("tds,expected", [(0.0, 3), (300.0, 3), (300.01, 2), (600.0, 2),
                                          (600.01, 1), (900.0, 1), (900.01, 0), (5000.0, 0)])
def test_tds_grade_boundaries(spark, tds, expected):
    assert rows(spark, [(tds, 0.0, 7.0)]).select(tds_grade()).first()[0] == expected


@pytest.mark.parametrize("u,expected", [(0.0, 3), (1.0, 3), (1.01, 2), (4.0, 2), (4.01, 1),
                                        (10.0, 1), (10.01, 0), (100.0, 0)])
def test_turbidity_grade_boundaries(spark, u, expected):
    assert rows(spark, [(0.0, u, 7.0)]).select(turbidity_grade()).first()[0] == expected


def test_quality_class_all_grade_combinations(spark):
    # integer form equals the weighted float rule for all 64 grade combinations
    from itertools import product
    reps = {3: (250.0, 0.5, 7.2), 2: (500.0, 2.0, 8.0), 1: (800.0, 5.0, 6.2), 0: (1500.0, 20.0, 5.0)}
    data = []
    for a, b, c in product(range(4), repeat=3):
        data.append((reps[b][0], reps[c][1], reps[a][2], a, b, c))
    df = rows(spark, data, "tds double, turbidity double, ph double, a int, b int, c int")
    for row in df.select("a", "b", "c", quality_class().alias("q")).collect():
        s = 0.4 * row.a + 0.3 * row.b + 0.3 * row.c
        exp = 3 if s >= 2.5 else 2 if s >= 1.5 else 1 if s >= 0.5 else 0
        assert row.q == exp


def test_rule_class_is_python_round(spark):
    for s in range(10):
        assert math.floor((s + 1) / 3) == int(round(s / 3))
    df = rows(spark, [(250.0, 0.5, 7.2), (1500.0, 20.0, 5.0), (500.0, 2.0, 7.2)])
    assert [r[0] for r in df.select(rule_class()).collect()] == [3, 0, 2]


def test_validation_fixture(spark):
    df = rows(spark, [(300.0, 2.0, 7.0), (300.0, 2.0, 15.0), (-100.0, 2.0, 7.0)])
    v = validate(df).select("valid", "errors").collect()
    assert [x.valid for x in v] == [True, False, False]
    assert v[1].errors == ["pH 15.0 is outside realistic range (4.0-12.0)"]
    assert v[2].errors == ["TDS -100.0 mg/L is outside realistic range (0-5000)"]


def test_golden_record_warning(spark):
    df = rows(spark, [(975.0, 8.13, 4.0)])
    v = validate(df).first()
    assert v.valid and v.warnings == ["pH 4.0 is outside typical drinking water range (6.0-9.0)"]
    assert df.select(first_error()).first()[0] is None


def test_missing_values_semantics(spark):
    df = spark.createDataFrame([(300.0, 2.0, float("nan")), (300.0, 2.0, None)],
                               "tds double, turbidity double, ph double")
    errs = [r[0] for r in df.select(first_error()).collect()]
    assert errs == ["pH value nan is outside valid range (4.0-12.0)",
                    "pH value None is outside valid range (4.0-12.0)"]
    # full validation skips missing values (NaN treated as missing)
    assert [r.valid for r in validate(df).collect()] == [True, True]
    assert [r[0] for r in df.select(is_valid()).collect()] == [False, False]


def test_simple_wqi_ranges(spark):
    w = [r[0] for r in rows(spark, [(200.0, 0.5, 7.0), (1500.0, 20.0, 5.0)]).select(wqi_simple()).collect()]
    assert 80 <= w[0] <= 100 and 0 <= w[1] <= 40


def test_demo_classifier_http_cases(spark):
    df = rows(spark, [(200.0, 0.5, 7.2), (975.0, 8.13, 4.0), (1500.0, 15.0, 10.5)])
    got = df.select(demo_class(demo_score()).alias("c"), demo_confidence(demo_score()).alias("p")).collect()
    assert [g.c for g in got] == [3, 0, 0]
    assert [g.p for g in got] == [0.9, 0.6, 0.6]


def test_service_wqi_tds_jump(spark):
    # quirk Q-5: the TDS sub-index drops at 600 then jumps at 600.01
    a, b = [r[0] for r in rows(spark, [(600.0, 0.5, 7.2), (600.01, 0.5, 7.2)])
            .select(wqi_service()).collect()]
    assert a == pytest.approx(0.4 * 100 + 0.3 * 0 + 0.3 * 100)
    assert b > a


def test_py_round_matches_python(spark):
    random.seed(7)
    vals = [67.865, 2.675, -2.675, 0.125, 0.375, 1.005, 59.775] + [
        round(random.uniform(-1000, 1000), 3) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for n in (0, 1, 2):
        got = [r[0] for r in df.select(py_round("x", n)).collect()]
        assert got == [round(v, n) for v in vals]


def test_output_rounding_matches_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    random.seed(3)
    vals = [(i + 0.5) / 1e6 for i in range(-500, 500)] + [random.uniform(-1e4, 1e4) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [x[0] for x in df.select(r("x")).collect()]
    con = duckdb.connect()
    exp = [x[0] for x in con.execute("SELECT round(x, 6) FROM (SELECT unnest(?) AS x)", [vals]).fetchall()]
    assert got == exp


def method_sizes(df, capsys):
    """Bytecode sizes of the longest generated methods of a plan's stages."""
    capsys.readouterr()
    df.explain("codegen")
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def test_feature_queries_fit_into_methods_that_the_jvm_compiles(spark, tmp_path, capsys):
    from limnos.plans.q_features import f00_all_features, f00_all_features_lineitem
    from limnos.plans.q_ml import p01_features_target
    (spark.range(50).selectExpr("id AS l_orderkey", "id * 7 AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "double(id) AS l_quantity",
                                "id * 900.5D AS l_extendedprice", "'A' AS l_returnflag", "'F' AS l_linestatus", "timestamp '2024-01-01' AS l_shipdate")
     .write.parquet(str(tmp_path / "lineitem.parquet")))
    (spark.range(50).selectExpr("id AS event_id", "id * 3 AS user_id", "'view' AS event_type", "timestamp_ntz '2024-01-01 00:00:00' AS ts",
                                "id * 9.5D AS value", "concat('{\"k\": ', id, '}') AS props")
     .write.parquet(str(tmp_path / "events.parquet")))
    for query in (f00_all_features_lineitem, f00_all_features, p01_features_target):
        sizes = method_sizes(query(spark, str(tmp_path)), capsys)
        assert sizes and max(sizes) < 8000


def test_scaling_fits_into_methods_that_the_jvm_compiles(spark, tmp_path, capsys):
    from limnos.plans.q_ml import m02_scale_features
    (spark.range(200).selectExpr("id AS event_id", "id * 3 AS user_id", "'view' AS event_type", "timestamp_ntz '2024-01-01 00:00:00' AS ts",
                                 "id % 60 * 9.5D AS value", "concat('{\"k\": ', id % 90, '}') AS props")
     .write.parquet(str(tmp_path / "events.parquet")))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")     # the adaptive plan shows no code before it runs
    try:
        sizes = method_sizes(m02_scale_features(spark, str(tmp_path)), capsys)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) < 8000


def test_rounding_of_halves_and_special_values(spark):
    below = 0.49999999999999994
    got = [x[0] for x in spark.createDataFrame([(v,) for v in (0.5, -0.5, 1.5, -2.5, below, -below, 4503599627370497.5, -0.2, float("nan"), None)],
                                               "x double").select(r("x", 0)).collect()]
    assert got[:8] == [1.0, -1.0, 2.0, -3.0, 0.0, 0.0, 4503599627370498.0, 0.0] and math.copysign(1, got[7]) == 1
    assert math.isnan(got[8]) and got[9] is None


def test_scoring_chain_record(spark):
    df = rule_model(rows(spark, [(250.0, 0.8, 7.2), (975.0, 8.13, 4.0), (1500.0, 15.0, 13.0)]))
    rec = prediction_record(df).collect()
    assert rec[0].prediction.quality_label == "Excellent"
    assert 0 < rec[0].prediction.confidence <= 0.98
    assert rec[1].prediction.quality_class == 0
    assert rec[2].error == "pH value 13.0 is outside valid range (4.0-12.0)" and rec[2].prediction is None
    e = enhance(df).collect()
    for x in e:
        assert x.confidence <= 0.98
        assert x.enhancement_applied == (x.confidence > x.base_confidence)


def test_fine_grades(spark):
    got = [r[0] for r in rows(spark, [(0.0, 0.0, p) for p in (7.2, 6.9, 6.6, 6.2, 5.6, 5.4)])
           .select(ph_grade_fine()).collect()]
    assert got == [4.0, 3.5, 3.0, 2.0, 1.0, 0.0]


def test_label_readings(spark):
    out = label_readings(rows(spark, [(250.0, 0.5, 7.2)])).first()
    assert (out.quality, out.quality_label) == (3, "Excellent")


def test_feature_sweep(spark):
    import numpy as np
    from limnos.operators.sweep import feature_sweep, guidelines
    out = feature_sweep(spark, "ph").orderBy("reading_id").collect()
    assert len(out) == 100
    assert [x.ph for x in out] == pytest.approx(list(np.linspace(5.0, 9.0, 100)))
    # pH 7.0-7.5 with tds 300 and turbidity 2 -> grades 3/3/2 -> Good or better
    assert {x.quality_label for x in out if 7.0 <= x.ph <= 7.5} <= {"Good", "Excellent"}
    assert guidelines(spark).count() == 11
