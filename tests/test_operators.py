"""Distributed operators checked against brute force on small fixtures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limnos.operators import evaluate as EV
from limnos.operators import ml, profile
from limnos.operators.order_stats import order_statistics, quantiles
from limnos.operators.smote import nearest_neighbors, smote
from limnos.operators.standards import agency_compliance
from limnos.operators.validate import with_row_index
from limnos.schema import AGENCY_STANDARDS


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(11)
    data = []
    for i in range(3000):
        hot = i % 3 == 0  # a third of all rows share one value
        data.append((i, i % 4, 42.0 if hot else random.uniform(0, 1000)))
    return spark.createDataFrame(data, "id long, g int, x double"), data


def test_order_statistics_with_hot_value(spark, skewed):
    df, data = skewed
    xs = sorted(x for _, _, x in data)
    ranks = [0, 1, 999, 1000, 1500, 2999]
    got = order_statistics(df, "x", {r: (None, r) for r in ranks})
    assert [got[r] for r in ranks] == [xs[r] for r in ranks]
    per = {}
    for _, g, x in data:
        per.setdefault(g, []).append(x)
    t = {(g, k): (g, k) for g in per for k in (0, len(per[g]) // 2, len(per[g]) - 1)}
    got = order_statistics(df, "x", t, group="g")
    for (g, k) in t:
        assert got[(g, k)] == sorted(per[g])[k]


def test_quantiles_match_numpy(spark, skewed):
    df, data = skewed
    q = quantiles(df, "x", [0.25, 0.5, 0.75])
    xs = np.array([x for _, _, x in data])
    for p in (0.25, 0.5, 0.75):
        assert q[(None, p)] == pytest.approx(np.quantile(xs, p), rel=1e-12)


def test_stratified_split_exact_and_stable(spark):
    data = [(i, 0 if i % 10 < 6 else 1 if i % 10 < 9 else 2) for i in range(1000)] + [(5000, 3)]
    df = spark.createDataFrame(data, "reading_id long, quality int")
    a = ml.stratified_split(df)
    b = ml.stratified_split(df.repartition(7))
    assert sorted(a.collect()) == sorted(b.collect())
    counts = {(r.quality, r.split): r["count"] for r in a.groupBy("quality", "split").count().collect()}
    for c, n in ((0, 600), (1, 300), (2, 100)):
        n_test = int(n * 0.2 + 0.5)
        n_val = int((n - n_test) * 0.25 + 0.5)
        assert counts.get((c, "test"), 0) == n_test
        assert counts.get((c, "val"), 0) == n_val
        assert counts.get((c, "train"), 0) == n - n_test - n_val
    # a one-row class keeps its row in train (round(0.2) = 0 test rows)
    assert counts.get((3, "train")) == 1


def _brute_knn(pts, k):
    out = {}
    for pid, c, x in pts:
        cand = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), nid) for nid, c2, y in pts
                      if c2 == c and nid != pid)
        out[pid] = [nid for _, nid in cand[:k]]
    return out


def test_grid_knn_equals_brute_force(spark):
    random.seed(5)
    pts = []
    for i in range(600):
        c = 0 if i < 400 else 1
        x = (round(random.expovariate(1 / 300), 2), random.randint(0, 99) / 4, random.randint(35, 105) / 10)
        pts.append((i, c, x))
    pts += [(1000 + j, 1, pts[500][2]) for j in range(4)]  # exact duplicates
    pts += [(2000, 2, (1.0, 1.0, 7.0)), (2001, 2, (2.0, 1.0, 7.0)), (2002, 2, (900.0, 9.0, 5.0))]
    df = spark.createDataFrame([(i, c, *x) for i, c, x in pts],
                               "reading_id long, quality int, tds double, turbidity double, ph double")
    nn = nearest_neighbors(df, 5)
    got = {}
    for row in nn.orderBy("pid", "rank").collect():
        got.setdefault(row.pid, []).append(row.nid)
    assert got == _brute_knn(pts, 5)


def test_knn_of_many_identical_readings(spark):
    same = spark.range(100_000).selectExpr("id AS reading_id", "0 AS quality", "300.0D AS tds", "2.0D AS turbidity",
                                           "7.0D AS ph")
    odd = spark.createDataFrame([(200_000, 0, 301.0, 2.0, 7.0), (200_001, 0, None, 2.0, 7.0),
                                 (200_002, 0, float("inf"), 2.0, 7.0), (200_003, 0, float("nan"), 2.0, 7.0)],
                                "reading_id long, quality int, tds double, turbidity double, ph double")
    nn = nearest_neighbors(same.unionByName(odd), 5)
    assert nn.count() == 100_001 * 5
    near = {r.pid: [x for x in r.n] for r in nn.where("pid IN (2, 50000, 200000)").groupBy("pid")
            .agg(F.array_sort(F.collect_list("nid")).alias("n")).collect()}
    assert near == {2: [0, 1, 3, 4, 5], 50_000: [0, 1, 2, 3, 4], 200_000: [0, 1, 2, 3, 4]}


def test_smote_balances_classes(spark):
    random.seed(9)
    data = [(i, 0 if i < 300 else 1 if i < 360 else 2, random.uniform(0, 900), random.uniform(0, 20),
             random.uniform(4, 12)) for i in range(364)]
    df = spark.createDataFrame(data, "reading_id long, quality int, tds double, turbidity double, ph double")
    out = smote(df)
    counts = {r.quality: r["count"] for r in out.groupBy("quality").count().collect()}
    assert counts == {0: 300, 1: 300, 2: 300}
    # synthetic points lie on a segment between a base row and a same-class neighbour
    syn = out.where(F.col("copy") >= 0)
    assert syn.where((F.col("tds") < 0) | (F.col("tds") > 900)).count() == 0


def test_row_index_dense(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k").repartition(6)
    out = with_row_index(df, "k", "i", 1).orderBy("k").collect()
    assert [r.i for r in out] == list(range(1, len(out) + 1))


def test_row_index_of_equal_keys_nulls_and_clashing_names(spark):
    data = [(i % 7 if i % 3 else None, f"v{i % 40}", i) for i in range(400)] + [(3, "v1", 1)] * 50
    df = spark.createDataFrame(data, "k int, name string, row_index long").repartition(6)
    out = with_row_index(df, ["k", "name"], "row_index", 0)
    assert out.columns == ["k", "name", "row_index"]
    rows = sorted(out.collect(), key=lambda x: x.row_index)
    assert [x.row_index for x in rows] == list(range(450))
    order = [(x.k is not None, x.k or 0, x.name) for x in rows]
    assert order == sorted(order)
    assert sorted((x[0] is None, x[0] or 0, x[1]) for x in data) == sorted((x.k is None, x.k or 0, x.name) for x in rows)
    assert with_row_index(df.limit(0), "k", "i").count() == 0


def test_row_index_writes_keys_only(spark):
    df = spark.range(2000).select((F.col("id") * 7 % 2003).alias("k"), F.repeat(F.lit("x"), 100).alias("wide"))
    out = with_row_index(df, "k", "i", 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    written = [x for x in plan.splitlines() if "LogicalRDD" in x]
    assert written and all("wide" not in x for x in written)
    assert [x.i for x in out.orderBy("k").collect()] == list(range(1, 2001))


def test_ordered_reports_come_in_order(spark):
    from limnos.operators.profile import ordered_distribution
    df = spark.createDataFrame([(c, f"q{c}") for c, n in ((3, 5), (0, 9), (2, 5), (1, 1)) for _ in range(n)],
                               "quality int, quality_label string").repartition(5)
    by_class = ordered_distribution(df, "class").collect()
    assert [(x.position, x.quality) for x in by_class] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    by_count = ordered_distribution(df, "count").collect()
    assert [(x.position, x.quality, x.n) for x in by_count] == [(1, 0, 9), (2, 2, 5), (3, 3, 5), (4, 1, 1)]
    assert ordered_distribution(df.limit(0)).collect() == []


def test_histogram_matches_numpy(spark):
    random.seed(2)
    data = [("a", random.uniform(0, 50)) for _ in range(500)] + [("b", 5.0), ("b", 5.0)]
    df = spark.createDataFrame(data, "g string, x double")
    h = {(r.g, r.bin): r.n for r in profile.histogram_by_class(df, "x", "g", 30).collect()}
    xs = [x for g, x in data if g == "a"]
    counts, _ = np.histogram(xs, bins=30)
    assert [h[("a", i)] for i in range(30)] == list(counts)
    assert h[("b", 15)] == 2 and sum(v for (g, _), v in h.items() if g == "b") == 2


def test_agency_compliance_bands(spark):
    vals = [(7.0, 300.0, 1.0), (6.7, 550.0, 4.5), (9.5, 1600.0, 30.0), (8.0, 1000.0, 2.0)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(vals)],
                               "reading_id long, ph double, tds double, turbidity double")
    got = {(r.reading_id, r.agency, r.parameter): r.grade for r in agency_compliance(df).collect()}

    def grade(agency, param, v):
        s = AGENCY_STANDARDS[agency][param]
        for g in ("excellent", "good", "acceptable"):
            if param == "ph":
                if s[g][0] <= v <= s[g][1]:
                    return g
            elif v <= s[g]:
                return g
        return "poor"

    for i, (ph, tds, tu) in enumerate(vals):
        for a in AGENCY_STANDARDS:
            for p, v in (("ph", ph), ("tds", tds), ("turbidity", tu)):
                assert got[(i, a, p)] == grade(a, p, v), (i, a, p)


def test_class_weights_and_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (2, 0)],
                               "quality int, predicted int")
    w = {r.quality: r.weight for r in ml.class_weights(df).collect()}
    assert w == {0: 1.0, 1: 1.0, 2: 1.0}
    rep = {r.label: r for r in EV.classification_report(df, "quality", "predicted").collect()}
    assert rep["1"].precision == pytest.approx(2 / 3) and rep["1"].recall == 1.0
    assert rep["3"].support == 0 if "3" in rep else True
    cm = {r.actual: r for r in EV.confusion_matrix(df, "quality", "predicted").collect()}
    assert cm[3].pred_0 == 0 and cm[0].pred_1 == 1


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    s = ml.PopulationScaler(["a", "b"]).fit(df)
    out = s.transform(df).collect()
    assert [r.a for r in out] == [-1.0, 1.0] and [r.b for r in out] == [0.0, 0.0]


def test_describe_matches_pandas(spark):
    pd = pytest.importorskip("pandas")
    random.seed(4)
    data = [(random.uniform(0, 100), random.choice([1.0, 2.0, 2.0, 7.5]), random.gauss(7, 1))
            for _ in range(777)]
    df = spark.createDataFrame(data, "tds double, turbidity double, ph double")
    d = {r.column: r for r in profile.describe(df).collect()}
    ref = pd.DataFrame(data, columns=["tds", "turbidity", "ph"]).describe()
    for c in ("tds", "turbidity", "ph"):
        assert d[c]["count"] == 777
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                             ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert d[c][ours] == pytest.approx(ref.loc[theirs, c], rel=1e-9)


def test_order_statistics_are_exact_on_big_integers_and_infinities(spark):
    big = [2 ** 53 + i for i in range(12)] + [-2 ** 63, 2 ** 63 - 1]
    df = spark.createDataFrame([(x,) for x in big], "x long")
    got = order_statistics(df, "x", {i: (None, i) for i in range(len(big))})
    assert [got[i] for i in range(len(big))] == sorted(big)
    inf = float("inf")
    xs = [inf, -inf, 1.0, 2.5, float("nan"), None, 1e308, -1e308, 5e-324, inf]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    want = sorted(x for x in xs if x is not None and x == x)
    got = order_statistics(df, "x", {i: (None, i) for i in range(len(want))})
    assert [got[i] for i in range(len(want))] == want
    with pytest.raises(ValueError):
        order_statistics(df, "x", {0: (None, len(want))})


@pytest.mark.parametrize("direct", [0, 1 << 16])
def test_order_statistics_of_many_values(spark, direct):
    """Ranks of 40,000 values of all scales, on the driver's walk and on the bisection of counted values."""
    rng = np.random.default_rng(3)
    inf = float("inf")
    doubles = np.concatenate([rng.normal(size=20_000) * 10.0 ** rng.integers(-300, 300, 20_000), np.full(15_000, 7.25),
                              np.full(2_500, inf), np.full(2_500, -inf)])
    longs = np.concatenate([rng.integers(-2 ** 63, 2 ** 63 - 1, 20_000), np.full(20_000, 2 ** 62 + 1)])
    df = spark.createDataFrame(list(zip(doubles.tolist(), longs.tolist())), "d double, l long").repartition(8)
    ranks = [0, 1, 2_499, 2_500, 9_999, 20_000, 33_333, 37_499, 37_500, 39_999]
    for col, values in (("d", np.sort(doubles)), ("l", np.sort(longs))):
        got = order_statistics(df, col, {r: (None, r) for r in ranks}, direct=direct)
        assert [got[r] for r in ranks] == values[ranks].tolist()


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    from limnos.operators import order_stats
    monkeypatch.setattr(order_stats, "_below", lambda v, number: number(10 ** 6))    # a sketch that is wrong
    df = spark.range(5000).select(F.col("id").alias("x"))
    assert order_statistics(df, "x", {0: (None, 2500)}) == {0: 2500}


def test_seeds_give_unrelated_samples(spark):
    from limnos.sources.samples import sample_n
    df = spark.range(100_000).withColumnRenamed("id", "reading_id")
    a, b = ({r[0] for r in sample_n(df, 2000, seed=s).collect()} for s in (42, 43))
    assert len(a) == 2000 and len(a & b) < 100


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    from limnos.streaming import monitor
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        out = monitor.run_append(spark, monitor.events_stream(spark, d).select("reading_id"), "parts")
        assert out.count() == events.count()


def _scored_rows(n=1200):
    random.seed(21)
    out = []
    for i in range(n):
        top = random.choice([0.4, 0.55, 0.7, 0.85, 0.95])
        p = [(1 - top) / 3] * 4
        guess = i % 4
        p[guess] = top
        label = guess if random.random() < top ** 2 else (guess + 1 + i % 3) % 4
        out.append((i, label, p))
    return out


SCORED = "reading_id long, quality int, probability array<double>"


def test_platt_is_the_penalised_optimum(spark):
    from limnos.operators import calibrate as C
    data = _scored_rows()
    x = np.array([max(p) for _, _, p in data])
    y = np.array([float(p[t] == max(p)) for _, t, p in data])
    got = C.fit_platt(spark.createDataFrame(data, SCORED))
    e = y - 1 / (1 + np.exp(-(got.intercept + got.slope * x)))
    assert abs(e.sum()) < 1e-7 and abs((e * x).sum() - got.slope) < 1e-7
    sure = spark.createDataFrame([(i, 0, [0.7, 0.1, 0.1, 0.1]) for i in range(9)], SCORED)
    assert C.fit_platt(sure).intercept == pytest.approx(math.log(17)) and C.fit_platt(sure.limit(0)).slope == 0


def slow_isotonic(x, hit):
    """Pooled blocks (lo, hi, hits, n), by hand."""
    out = []
    points = pd.DataFrame({"t": x, "h": hit}).groupby("t").h.agg(["sum", "count"])
    for t, h, k in zip(points.index, points["sum"], points["count"]):
        out.append([t, t, h, k])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            lo, _, h, n = out.pop(-2)
            out[-1] = [lo, out[-1][1], out[-1][2] + h, out[-1][3] + n]
    return [tuple(b) for b in out]


@pytest.mark.parametrize("block_rows", [100_000, 40])
def test_isotonic_blocks_match_pooling_by_hand(spark, monkeypatch, block_rows):
    from limnos.operators import calibrate as C
    monkeypatch.setattr(C, "BLOCK_ROWS", block_rows)        # 40: many ranges and rounds
    rng = np.random.default_rng(5)
    n = 100_000 if block_rows > 40 else 3000
    top = np.round(0.3 + 0.7 * rng.random(n), 4 if block_rows > 40 else 9)
    hit = rng.random(n) < 0.2 + 0.6 * top ** 3
    rows = pd.DataFrame({"p": [[t, (1 - t) / 3, (1 - t) / 3, (1 - t) / 3] for t in top], "y": np.where(hit, 0, 1)})
    df = spark.createDataFrame(rows, "p array<double>, y int").repartition(7)
    got = C.fit_isotonic(df, "p", "y")
    want = slow_isotonic(top, hit)
    blocks = sorted(tuple(b) for b in got.blocks.select("lo", "hi", "hits", "n").collect())
    assert [b[2:] for b in blocks] == [b[2:] for b in want]
    assert np.allclose([b[:2] for b in blocks], [b[:2] for b in want], atol=1e-11)
    grid = [0.0, 0.31, 0.5, 0.77, 0.999, 1.0, blocks[1][0], (blocks[0][1] + blocks[1][0]) / 2]
    out = got.apply(spark.createDataFrame([(float(v),) for v in grid], "t double"), "t", "c").collect()
    edges, values = np.ravel([b[:2] for b in blocks]), np.repeat([b[2] / b[3] for b in blocks], 2)
    assert [r["c"] for r in out] == pytest.approx(np.interp([r["t"] for r in out], edges, values).tolist(), abs=1e-9)


def test_temperature_is_the_minimum(spark):
    from limnos.operators import calibrate as C
    rng = np.random.default_rng(2)
    for scale in (0.3, 1.0, 4.0, 200.0, 0.001):
        z = rng.normal(size=(400, 4)) * 2
        p = np.exp(z / 1.0)
        y = [int(rng.choice(4, p=v / v.sum())) for v in p]
        logits = z * scale
        df = spark.createDataFrame([(i, y[i], logits[i].tolist()) for i in range(400)], "id long, quality int, logits array<double>")
        t = C.fit_temperature(df)["temperature"]

        def nll(t):
            x = logits / t
            return float((np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) + x.max(1) - x[np.arange(400), y]).sum())

        near = [v for v in (t * (1 - 1e-4), t * (1 + 1e-4)) if 0.1 <= v <= 10]
        assert all(nll(t) <= nll(v) + 1e-12 for v in near)
        grid = np.geomspace(0.1, 10, 400)
        assert nll(t) <= min(map(nll, grid)) + 1e-9


@pytest.mark.parametrize("method", ["temperature", "platt", "isotonic", "ensemble"])
def test_calibrator_is_the_same_after_save_and_load(spark, tmp_path, method):
    from limnos.operators import calibrate as C
    df = C.with_logits(spark.createDataFrame(_scored_rows(400), SCORED))
    cal = C.Calibrator(method).fit(df)
    back = C.Calibrator.load(spark, cal.save(spark, str(tmp_path / "cal")))
    a, b = ({x.reading_id: x.calibrated_confidence for x in c.apply(df).collect()} for c in (cal, back))
    assert a == b and len(a) == 400 and back.weights == cal.weights


@pytest.mark.parametrize("label", [None, 4])
def test_calibration_rejects_a_label_that_is_no_class(spark, label):
    from limnos.operators import calibrate as C
    df = C.with_logits(spark.createDataFrame([(1, label, [0.7, 0.1, 0.1, 0.1]), (2, 0, [0.7, 0.1, 0.1, 0.1])], SCORED))
    for fit in (lambda: C.fit_temperature(df), lambda: C.fit_platt(df), lambda: C.fit_isotonic(df)):
        with pytest.raises(Exception, match="no class"):
            fit()


def test_method_selection_scores_every_method(spark):
    from limnos.operators import calibrate as C
    df = C.with_logits(spark.createDataFrame(_scored_rows(), SCORED))
    got = {x.method: x for x in C.select_method(df).collect()}
    assert set(got) == {"temperature", "platt", "isotonic"} and sum(x.is_best for x in got.values()) == 1
    assert got["platt"].confidence_change == pytest.approx(0.0, abs=1e-9)
    assert got["platt"].calibrated_accuracy == got["platt"].original_accuracy


def test_metrics_keep_classes_beside_the_list(spark):
    df = spark.createDataFrame([(0, 0), (0, 7), (1, 1)], "quality int, predicted int")
    cm = {x.actual: x for x in EV.confusion_matrix(df, "quality", "predicted").collect()}
    assert cm[0].pred_7 == 1 and set(cm) == {0, 1, 2, 3, 7}
    assert EV.confusion_counts(df, "quality", "predicted").agg(F.sum("n")).first()[0] == 3
    s = {x.label: (x.accuracy, x.support) for x in EV.summary(df, "quality", "predicted").collect()}
    assert s["0"] == (0.5, 2) and s["2"] == (0.0, 0) and s["all"] == (pytest.approx(2 / 3), 3)
    with pytest.raises(ValueError):
        EV.summary(spark.createDataFrame([(0, None)], "quality int, predicted int"), "quality", "predicted")


def test_net_has_the_configured_shape_and_learns(spark):
    from limnos.operators import model as MD
    random.seed(3)
    data = []
    for i in range(400):
        c = i % 4
        data.append((i, c, c - 1.5 + random.gauss(0, 0.1), 1.5 - c + random.gauss(0, 0.1), random.gauss(0, 0.1)))
    df = spark.createDataFrame(data, "reading_id long, quality int, tds double, turbidity double, ph double")
    model = MD.train(df, ["tds", "turbidity", "ph"], kind="mlp")
    assert list(model.stages[-1].getLayers()) == [3, 64, 32, 16, 4]
    out = MD.predicted_class(MD.model_probabilities(model)(df))
    assert out.where("predicted = quality").count() >= 360


def test_synthetic_rows_follow_the_seed_and_the_whole_id(spark):
    random.seed(9)
    data = [(i, 0 if i % 5 else 1, random.random() * 100, random.random() * 9, 7.0) for i in range(200)]
    data += [(i + 2 ** 33, 1, t, u, p) for i, q, t, u, p in data if q == 1]      # the same points under far ids
    df = spark.createDataFrame(data, "reading_id long, quality int, tds double, turbidity double, ph double")
    runs = []
    for seed in (42, 43):
        out = smote(df, seed=seed).where("copy >= 0").collect()
        runs.append({(x.source_id, x.copy): (x.tds, x.turbidity) for x in out})
    both = set(runs[0]) & set(runs[1])
    assert len(both) > 20 and sum(runs[0][k] != runs[1][k] for k in both) > 0.7 * len(both)
    again = {(x.source_id, x.copy): (x.tds, x.turbidity) for x in smote(df.repartition(5)).where("copy >= 0").collect()}
    assert again == runs[0]
