"""Exact neighbours on the k-d partition, against all pairs in numpy."""

from __future__ import annotations

import numpy as np
import pytest

from limnos.operators import knn
from limnos.operators.knn import Splits, nearest_in, neighbor_lists

FEATS = ["tds", "turbidity", "ph"]
ROW = "reading_id long, quality int, tds double, turbidity double, ph double"


def frame(spark, ids, c, x):
    return spark.createDataFrame([(int(i), int(q), *map(float, v)) for i, q, v in zip(ids, c, x)], ROW)


def wrong(lists, ids, c, x, k):
    out = 0
    for r in lists:
        same = np.flatnonzero(c == r["_c"])
        d = ((r.tds - x[same, 0]) ** 2 + (r.turbidity - x[same, 1]) ** 2) + (r.ph - x[same, 2]) ** 2
        order = np.lexsort((ids[same], d))[:k + 1]
        out += [(d[i], int(ids[same][i])) for i in order] != [(n["d2"], n["id"]) for n in r["_nn"]]
    return out


@pytest.mark.parametrize("shape", ["even", "ties", "line"])
def test_lists_equal_all_pairs(spark, shape):
    rng = np.random.default_rng(4)
    n = 900
    x = rng.uniform(0, 50, size=(n, 3))
    if shape == "ties":
        x = np.round(rng.normal(size=(n, 3)) * 3)      # equal points and equal distances
    if shape == "line":
        x[:, 1:] = 7.0                                 # two axes without any span
    c = rng.integers(0, 2, n)
    c[:4] = 2                                          # a class of fewer rows than k + 1
    ids = rng.permutation(n) * 5 + 2 ** 60
    lists = neighbor_lists(frame(spark, ids, c, x), 5, "quality", "reading_id", FEATS, leaf_points=40).collect()
    assert len(lists) == len({(q, *v) for q, v in zip(c, map(tuple, x))})
    assert wrong(lists, ids, c, x, 5) == 0
    assert max(r["_leaves"] for r in lists) > 1


def test_far_point_reads_few_leaves_of_a_dense_cluster(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.normal(size=(n, 3))
    x[0] = [5e5, 4e5, 3e5]
    c = np.zeros(n, dtype=int)
    lists = neighbor_lists(frame(spark, np.arange(n), c, x), 5, "quality", "reading_id", FEATS, leaf_points=32).collect()
    assert wrong(lists, np.arange(n), c, x, 5) == 0
    far = next(r for r in lists if r["_nn"][0]["id"] == 0)
    assert far["_leaves"] <= 25                        # of 128 leaves and more
    assert sum(r["_leaves"] for r in lists) < 15 * n


def test_hot_leaf_is_dealt_in_lots(spark, monkeypatch):
    """A tiny cluster that every sparse point around it asks."""
    monkeypatch.setattr(knn, "LOT", 20)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 3)) * 1e-3, rng.normal(size=(300, 3)) * 100])
    c, ids = np.zeros(600, dtype=int), np.arange(600)
    lists = neighbor_lists(frame(spark, ids, c, x), 5, "quality", "reading_id", FEATS, leaf_points=32).collect()
    assert wrong(lists, ids, c, x, 5) == 0


def test_small_sample_still_gives_exact_lists(spark, monkeypatch):
    monkeypatch.setattr(knn, "SAMPLE", 200)
    rng = np.random.default_rng(7)
    x, c, ids = rng.uniform(0, 9, size=(1500, 3)), rng.integers(0, 3, 1500), np.arange(1500)
    lists = neighbor_lists(frame(spark, ids, c, x), 3, "quality", "reading_id", FEATS, leaf_points=16).collect()
    assert wrong(lists, ids, c, x, 3) == 0


def test_empty_and_odd_rows(spark):
    empty = spark.createDataFrame([], ROW)
    assert neighbor_lists(empty, 5, "quality", "reading_id", FEATS).count() == 0
    odd = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0), (2, 0, None, 1.0, 1.0), (3, None, 1.0, 1.0, 1.0),
                                 (4, 0, float("inf"), 1.0, 1.0), (5, 0, float("nan"), 1.0, 1.0)], ROW)
    got = neighbor_lists(odd, 5, "quality", "reading_id", FEATS).collect()
    assert [[n["id"] for n in r["_nn"]] for r in got] == [[1]]


def test_splits_send_points_to_leaves_of_bounded_size():
    rng = np.random.default_rng(8)
    x = np.round(rng.exponential(size=(5000, 3)) * 20)
    s = Splits([x, x[:10]], [5000, 10], 64)
    leaf = s.leaves(np.zeros(5000, dtype=int), x)
    assert len(s.leaf_class) - 1 == len(np.unique(leaf))
    biggest = max(len(np.unique(x[leaf == i], axis=0)) for i in np.unique(leaf))
    assert biggest <= 64
    assert set(s.leaves(np.ones(10, dtype=int), x[:10])) == {len(s.leaf_class) - 1}


def test_search_keeps_ties_by_row():
    p = np.array([[1.0], [0.0], [1.0], [-1.0], [5.0]])
    i, j, d = nearest_in(np.array([[0.0], [5.0]]), np.array([np.inf, 0.0]), p, 3)
    assert i.tolist() == [0, 0, 0, 1] and j.tolist() == [1, 0, 2, 4] and d.tolist() == [0, 1, 1, 0]
