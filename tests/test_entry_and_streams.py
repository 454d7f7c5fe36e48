"""Driver contract, streaming = batch twin, and oracle spot checks (sf0.001)."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from limnos.plans import QUERIES
from limnos.plans.common import r
from limnos.streaming import monitor as M
from limnos.sources.readings import events_readings


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = set(QUERIES)
    assert own <= set(q) and len(own) >= 90
    added = set(q) - own       # only where the training-data operators are installed
    assert not added or ("pipeline" in added and sum(n.startswith("op") for n in added) >= 10)


def test_entry_runs(spark):
    df = E.entry(spark)
    out = df.collect()
    assert len(out) > 0
    assert df.columns[:2] == ["quality_label", "n"]


def test_window_report_stream_equals_batch(spark):
    stream = M.window_report(M.scored_stream(M.events_stream(spark, SF001)))
    got = M.run_update(spark, stream, ["window_start", "site"], "test_t2")
    batch = M.window_report(M.scored_stream(events_readings(spark, SF001)))

    def norm(df):
        return sorted(tuple(x) for x in df.select(
            "window_start", "site", "n", "poor_alerts", "low_confidence",
            r("mean_confidence").alias("m")).collect())

    assert norm(got) == norm(batch)


def test_sessions_are_all_reported(spark):
    got = M.run_sessions(spark, M.events_stream(spark, SF001), "test_t4")
    batch = M.sessions(M.scored_stream(events_readings(spark, SF001)))
    cols = ["sensor_id", "session_start", "session_end", "n", "poor_alerts", "share_poor"]
    assert sorted(got.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    assert got.agg({"n": "sum"}).collect()[0][0] == M.scored_stream(events_readings(spark, SF001)).count()


SESSION_COLUMNS = ["sensor_id", "session_start", "session_end", "n", "poor_alerts", "share_poor", "avg_tds_good"]


def _parts_by_time(spark, folder, cuts):
    """A function that adds the n-th stretch of time of ``events`` to a stream's folder."""
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).collect()[0]
    edges = [lo + (hi - lo) * c for c in (0, *cuts, 1.0)]

    def add(i):
        own = ev.where((F.col("ts") >= edges[i]) & ((F.col("ts") < edges[i + 1]) if i < len(cuts) else F.lit(True)))
        own.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")

    return add


def _norm(df, columns):
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect())


def test_a_stopped_monitor_goes_on_where_it_stopped(spark, tmp_path):
    add = _parts_by_time(spark, tmp_path, (0.3, 0.7))
    stream = lambda: M.events_stream(spark, str(tmp_path))
    for i in range(3):
        add(i)
        scored = M.run_append(spark, M.scored_stream(stream()), "r1", str(tmp_path / "scored"))
        report = M.run_update(spark, M.window_report(M.scored_stream(stream())), ["window_start", "site"], "r2", str(tmp_path / "report"))
        sess = M.run_sessions(spark, stream(), "r3", path=str(tmp_path / "sessions"))
    assert [e["batch"] for e in M.finished_batches(spark, str(tmp_path / "report" / "manifest"))][:3] == [0, 1, 2]
    batch = M.scored_stream(events_readings(spark, SF001))
    assert _norm(scored, ["reading_id", "quality_class"]) == _norm(batch, ["reading_id", "quality_class"])
    cols = ["window_start", "site", "n", "mean_confidence"]
    assert _norm(report, cols) == _norm(M.window_report(batch), cols)
    assert _norm(sess, SESSION_COLUMNS) == _norm(M.sessions(batch), SESSION_COLUMNS)


def test_a_batch_lost_before_its_manifest_entry_is_written_again(spark, tmp_path, monkeypatch):
    add = _parts_by_time(spark, tmp_path, (0.5,))
    run = lambda: M.run_update(spark, M.window_report(M.scored_stream(M.events_stream(spark, str(tmp_path)))),
                               ["window_start", "site"], "r4", str(tmp_path / "report"))
    add(0)
    run()
    add(1)
    enter = M.enter_batch
    with monkeypatch.context() as m:
        m.setattr(M, "enter_batch", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(Exception):
            run()
    assert M.enter_batch is enter and M.finished_batches(spark, str(tmp_path / "report" / "manifest"))[-1]["batch"] <= 1
    cols = ["window_start", "site", "n", "mean_confidence"]
    assert _norm(run(), cols) == _norm(M.window_report(M.scored_stream(events_readings(spark, SF001))), cols)


def test_late_readings_follow_one_rule(spark, tmp_path):
    """Batch 2 brings readings before the watermark: dropped, whether their
    sensor has closed sessions or none; one behind others but not behind the
    watermark counts."""
    rows = lambda data: spark.createDataFrame(data, "event_id long, ts string, user_id long").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("a").alias("event_type"), F.lit(20.0).alias("value"),
        F.lit('{"k": 4}').alias("props"))
    folder = f"{tmp_path}/events.parquet"
    stream = lambda: M.events_stream(spark, str(tmp_path))
    rows([(0, "2024-01-01 00:00:00", 1), (36, "2024-01-01 12:00:00", 1), (72, "2024-01-01 12:10:00", 2)]).coalesce(1).write.parquet(folder)
    M.run_sessions(spark, stream(), "r5", path=str(tmp_path / "s"))
    late = [(108, "2024-01-01 01:00:00", 1), (144, "2024-01-01 01:00:00", 3), (180, "2024-01-01 11:30:00", 3), (216, "2024-01-01 13:00:00", 1)]
    rows(late).coalesce(1).write.mode("append").parquet(folder)
    got = M.run_sessions(spark, stream(), "r5", path=str(tmp_path / "s")).select("sensor_id", "n").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_sessions_read_the_input_once(spark):
    plan = M.run_sessions(spark, M.events_stream(spark, SF001), "test_plan")._jdf.queryExecution().executedPlan().toString()
    assert "events" not in plan.replace("event_ts", "")


def test_disagreeing_model_reaches_the_far_branches(spark):
    rows = E.queries()["e04_standards_enhance_disagreeing"](spark, SF001)
    far = rows.where("abs(rule_class - model_class) >= 2")
    assert far.where("quality_class = rule_class").count() > 0
    assert far.where("quality_class = model_class").count() > 0
    assert E.queries()["p06_low_confidence_disagreeing"](spark, SF001).count() > 0


def test_scored_stream_equals_batch(spark):
    stream = M.run_append(spark, M.scored_stream(M.events_stream(spark, SF001)), "test_t1")
    batch = M.scored_stream(events_readings(spark, SF001))
    cols = ["reading_id", "quality_class", "confidence"]
    assert sorted(stream.select(*cols).collect()) == sorted(batch.select(*cols).collect())


@pytest.mark.parametrize("name", ["c02_quality_class", "f00_all_features", "e12_final_prediction",
                                  "a03_describe", "m01_stratified_split", "j02_smote_neighbors",
                                  "t02_stream_window_report"])
def test_oracle_spot_checks(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    sdf = E.queries()[name](spark, SF001).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    cols = sorted(sdf.columns)

    def key(df):
        return sorted((tuple(None if (isinstance(v, float) and v != v) else
                            (round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v)
                            for v in rec) for rec in df[cols].astype(object).itertuples(index=False)),
                      key=lambda rec: [(v is not None, v) if v is not None else (False, 0) for v in rec])

    assert key(sdf) == key(odf)
