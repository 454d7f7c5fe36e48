"""Models: the net's gradient and training, one saved artefact over raw
readings, spot samples."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ROOT, SF001
from limnos.operators import ml
from limnos.operators import model as MD
from limnos.operators import net as N
from limnos.plans.common import labelled, valid

BASE3 = ["tds", "turbidity", "ph"]
SF01 = "/root/testdata/sf0.01"


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    sizes = [3, 5, 4, 3]
    flat = N.initial(sizes, 1) + rng.normal(size=sum(n * m + m for n, m in zip(sizes, sizes[1:]))) * 0.1
    x, y, w = rng.normal(size=(40, 3)), rng.integers(0, 3, 40), rng.random(40) + 0.5

    def loss(v):
        return N.gradient(v, sizes, x, y, w)[0] + N.penalty(v, sizes, 0.3)[0]

    got = N.gradient(flat, sizes, x, y, w)[1] + N.penalty(flat, sizes, 0.3)[1]
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, rel=1e-4, abs=1e-5)


def blobs(spark, n=600, parts=3, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = min(3, int(rng.exponential(1.2)))
        rows.append((i, [float(c - 1.5 + rng.normal(0, 0.45)), float(1.5 - c + rng.normal(0, 0.45))], c, 1.0, i % 4 == 0))
    return spark.createDataFrame(rows, "id long, x array<double>, y int, w double, val boolean").repartition(parts)


def test_loss_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(N, "TASK_ROWS", 1)
    config = N.NetConfig(hidden=(8, 6), epochs=25, rate=0.02)
    a = N.train_net(blobs(spark, parts=3), "x", "y", "w", "val", 2, config)
    monkeypatch.setattr(N, "FOLD", 4)          # 16 partials are added up in Spark first
    b = N.train_net(blobs(spark, parts=16), "x", "y", "w", "val", 2, config)
    assert len(a.history) == len(b.history) == 26
    for p, q in zip(a.history, b.history):
        assert p[1] == pytest.approx(q[1], abs=1e-9) and p[2] == pytest.approx(q[2], abs=1e-9)
    assert a.history[-1][1] < a.history[0][1] / 2
    assert a.history_frame(spark).count() == 26


def test_rows_are_packed_into_bounded_blocks(spark, monkeypatch):
    config = N.NetConfig(hidden=(8, 6), epochs=5, rate=0.02)
    data = blobs(spark)
    a = N.train_net(data, "x", "y", "w", "val", 2, config)
    monkeypatch.setattr(N, "BLOCK", 50)
    monkeypatch.setattr(N, "STEP", 7)
    b = N.train_net(data, "x", "y", "w", "val", 2, config)
    for p, q in zip(a.history, b.history):
        assert p[1] == pytest.approx(q[1], abs=1e-9) and p[2] == pytest.approx(q[2], abs=1e-9)
    blocks = data.mapInArrow(N._pack(2), N.PACKED).collect()
    assert max(r["n"] for r in blocks) <= 50 and sum(r["n"] for r in blocks) == 600
    assert sum(r["n"] for r in blocks if r["val"]) == 150 and all(len(r["x"]) == 16 * r["n"] for r in blocks)


def test_early_stop_keeps_the_best_and_cuts_the_rate(spark):
    noise = blobs(spark, 120).withColumn("y", F.when(F.col("val"), 3 - F.col("y")).otherwise(F.col("y")))
    got = N.train_net(noise, "x", "y", "w", "val", 2, N.NetConfig(hidden=(8,), epochs=60, stop_patience=6, cut_patience=3, rate=0.05))
    losses = [h[2] for h in got.history]
    assert len(losses) < 61 and losses.index(min(losses)) == len(losses) - 7
    assert got.history[-1][4] == pytest.approx(0.05 * 0.2)
    layers = N.unpack(got.parameters, got.sizes)
    rows = noise.where("val").collect()
    p = N.forward(layers, np.array([r["x"] for r in rows]))[1]
    extra = N.penalty(got.parameters, got.sizes, 1e-4)[0]
    assert min(losses) == pytest.approx(-np.log(p[np.arange(len(rows)), [r["y"] for r in rows]]).mean() + extra, abs=1e-9)


def test_class_weights_raise_the_rare_class(spark):
    data = blobs(spark, 900).where("y = 0 OR (y = 1 AND id % 6 = 0)").withColumn("val", F.lit(False))
    config = N.NetConfig(hidden=(6,), classes=2, epochs=60, rate=0.02)
    recall = []
    for w in (1.0, 20.0):
        got = N.train_net(data.withColumn("w", F.when(F.col("y") == 1, w).otherwise(1.0)), "x", "y", "w", "val", 2, config)
        rare = data.where("y = 1").collect()
        p = N.forward(N.unpack(got.parameters, got.sizes), np.array([r["x"] for r in rare]))[1]
        recall.append((p.argmax(axis=1) == 1).mean())
    assert recall[1] > recall[0]


def test_labels_that_fit_no_class_are_refused(spark):
    with pytest.raises(ValueError):
        N.train_net(blobs(spark, 40), "x", "y", "w", "val", 2, N.NetConfig(hidden=(4,), classes=2))
    with pytest.raises(ValueError):
        N.train_net(blobs(spark, 40).where("y > 9"), "x", "y", "w", "val", 2)


def test_one_scan_gives_scaler_and_counts(spark):
    df = labelled(spark, SF001)
    scaler, counts = ml.fit_moments(df, BASE3, "quality")
    want = ml.PopulationScaler(list(BASE3)).fit(df)
    assert counts == {r[0]: r[1] for r in df.groupBy("quality").count().collect()}
    for c in BASE3:
        assert scaler.means[c] == pytest.approx(want.means[c], rel=1e-12)
        assert scaler.stds[c] == pytest.approx(want.stds[c], rel=1e-12)
    with pytest.raises(ValueError):
        ml.fit_moments(spark.range(ml.MAX_CLASSES + 5).select("id", F.col("id").cast("double").alias("tds")), ["tds"], "id")


@pytest.fixture(scope="module")
def splits(spark):
    sp = ml.stratified_split(labelled(spark, SF01)).cache()
    return [sp.where(F.col("split") == s) for s in ("train", "val", "test")]


FRESH = """
import json, sys
sys.path.insert(0, {root!r})
from limnos.operators import model as MD
from limnos.plans.common import valid
from limnos.session import local_session
spark = local_session(cpus=2, app="limnos-fresh", driver_memory="2g")
rows = MD.model_probabilities(MD.load_model({path!r}))(valid(spark, {sf!r})).select("reading_id", "tds", "probability").collect()
print("ROWS" + json.dumps([[r[0], r[1], r[2]] for r in rows]))
spark.stop()
"""


@pytest.mark.parametrize("kind", ["rf", "net"])
def test_a_loaded_model_scores_raw_readings_in_a_fresh_process(spark, splits, tmp_path, kind):
    from limnos.functions.features import MODEL_FEATURES
    features = MODEL_FEATURES if kind == "rf" else BASE3
    model = MD.train(splits[0], features, kind=kind, validation=splits[1], net=N.NetConfig(hidden=(16, 8), epochs=40))
    path = MD.save_model(model, str(tmp_path / "model"))
    raw = valid(spark, SF001)
    here = MD.model_probabilities(model)(raw)
    assert here.columns == [*raw.columns, "probability"]
    want = {r["reading_id"]: (r["tds"], r["probability"]) for r in here.collect()}
    env = {**os.environ, "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", FRESH.format(root=ROOT, path=path, sf=SF001)], capture_output=True, text=True, env=env, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    got = json.loads(out.stdout.split("ROWS")[1])
    assert len(got) == len(want)
    for i, tds, p in got:
        assert tds == want[i][0] and p == pytest.approx(want[i][1], abs=1e-12)


def test_retrained_model_on_test_rows_and_spot_samples(spark, splits):
    from limnos.functions.features import MODEL_FEATURES
    model = MD.train(splits[0], MODEL_FEATURES)
    scored = MD.predicted_class(MD.model_probabilities(model)(splits[2]))
    assert scored.where("predicted = quality").count() / scored.count() > 0.95
    spots = {r["description"]: r for r in MD.spot_samples(spark, model).collect()}
    assert len(spots) == 5
    for r in spots.values():
        assert r["predicted"] == r["rule_class"] and 0.25 < r["top_probability"] <= 1


def test_net_learns_the_classes(spark, splits):
    model = MD.train(splits[0], BASE3, kind="net", validation=splits[1])
    scored = MD.predicted_class(MD.model_probabilities(model)(splits[2]))
    right = scored.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).collect()
    assert scored.where("predicted = quality").count() / scored.count() > 0.86 and min(r[1] for r in right) > 0.8
    history = model.stages[-1].history
    assert history[-1][1] < history[0][1] / 3
