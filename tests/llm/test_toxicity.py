"""Toxicity: held-out accuracy, parts against slow versions, odd tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import empty, frame, no_labels, odd, odd_rows  # noqa: F401
from limnos.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op13_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    bad, good = [r["score"] for r in out if r["toxic"] == 1], [r["score"] for r in out if r["toxic"] == 0]
    auc = np.mean([(b > np.array(good)).mean() + (b == np.array(good)).mean() / 2 for b in bad])
    assert np.mean(np.array(bad) >= 0.3) >= 0.88 and np.mean(np.array(good) >= 0.3) <= 0.01 and auc >= 0.96


def test_training_reads_no_held_out_label(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    spoilt = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: tuple(r) for r in toxicity.score_toxicity(d, la).collect()}
            for d, la in ((docs, labels), (docs.withColumn("lang", F.lit("x")).repartition(5), spoilt)))
    assert set(a) == set(b) and all(math.isclose(a[i][2], b[i][2], abs_tol=1e-5) for i in a)


def slow_features(text):
    chars = " " + (text or "").lower() + " "
    times = Counter()
    for n in toxicity.ORDERS:
        for i in range(len(chars) - n + 1):
            times[int(toxicity.grams(np.array([ord(c) for c in chars[i:i + n]], dtype=np.uint32))[-1])] += 1
    return set(times) | {b + toxicity.BUCKETS for b, k in times.items() if k >= 2 and 1000 * k >= len(chars)}


def test_features_and_scores_match_a_slow_version():
    rng = np.random.default_rng(0)
    texts = [None, "", "a", "abc", "You idiot, you IDIOT", "x" * 50, "long " * 300, "word " + "zq " * 700 + "\U0001F600\u0130"]
    chosen = rng.choice(2 * toxicity.BUCKETS, 5000, replace=False)
    chosen = np.unique(np.concatenate((chosen, toxicity.features(texts[4]), toxicity.features(texts[-1]))))
    weights = rng.normal(size=len(chosen))
    model = toxicity.Model.of(toxicity.Model(chosen, weights, -1.5).plain())
    table = dict(zip(chosen.tolist(), weights))
    for t in texts:
        got = toxicity.features(t)
        assert len(got) == len(set(got.tolist())) and set(got.tolist()) == slow_features(t)
        z = -1.5 + sum(table.get(f, 0) for f in slow_features(t))
        assert math.isclose(model.score(t), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_ratios_and_choice():
    counts, n = np.array([[5, 0, 50, 0], [5, 9, 5, 0.0]]), np.array([100, 10.0])
    ratio = toxicity.log_ratios(counts, n)
    assert np.allclose(ratio, [math.log(b / 12) - math.log(a / 102) for a, b in zip((6, 1, 51, 1), (6, 10, 6, 1))])
    assert toxicity.telling(counts, n, 1).tolist() == [1] and toxicity.telling(counts, n, 2).tolist() == [0, 1]
    assert 3 not in toxicity.telling(counts, n, 4)


def test_linear_fit_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((300, 12)) < 0.3
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(size=12) - 1)))).astype(float)
    scale, weight = rng.normal(size=12), np.where(y > 0, 0.5, 2.0)
    row, col = np.nonzero(x)
    w, b = toxicity.fit_linear(row, col, scale, y, weight, tolerance=1e-15, steps=500)
    v = w / scale
    e = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(np.append(scale * (x.T @ e) + v, e.sum())).max() < 1e-3


def test_odd_tables(spark, odd, empty, no_labels):
    rng = random.Random(2)
    names = ("_id", "_text", "_y", "held_out", "score", "predicted", "toxic", "feature", "at", "__lm_order")
    df = odd.select("*", *[F.lit("x").alias(n) for n in names])
    labels = spark.createDataFrame([(i, 1, rng.randint(0, 1)) for i in range(70)] + [(5, 0, None), (None, 1, 1), (6, 1, 1), (6, 1, 0)],
                                   "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    got = toxicity.score_toxicity(df, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in odd_rows())
    nothing = {r["score"] for r in got.filter("doc_id in (0, 1)").collect()}
    assert len(nothing) == 1
    for la, want in ((no_labels, 0.0), (labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0)):
        assert {round(r["score"], 9) for r in toxicity.score_toxicity(odd, la).collect()} == {want}
    assert toxicity.score_toxicity(empty, labels).count() == 0 and toxicity.score_toxicity(empty, no_labels).count() == 0


@pytest.mark.parametrize("max_fit", [40])
def test_a_bounded_sample_keeps_the_class_shares(spark, max_fit):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels, max_fit=max_fit).join(labels, "doc_id").agg(F.avg("score"), F.avg("toxic")).collect()[0]
    assert abs(got[0] - got[1]) < 0.08
