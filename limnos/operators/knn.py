"""Exact k nearest neighbours within each class on a k-d partition.

Rows of a class with equal sensors are one point that carries its k + 1
smallest ids, so any number of identical readings costs one point.  Splits
come from a sample of bounded size (all points while they fit): the widest
axis of a part is cut at its median until a leaf is expected to hold
``LEAF_POINTS`` points or few samples are left, so dense regions get small
leaves and empty ones none.  Every point is put into its leaf; the leaves'
true boxes are one aggregate of a row per leaf (``SAMPLE`` / ``MIN_SAMPLE`` at
most, for all classes together), which is what tasks are given.

A leaf first answers for its own points.  A point whose k-th distance reaches
into other boxes then asks their leaves, nearest box first: the ``FIRST_ASK``
nearest, then twice as many a round, each time only those that the shrunk
distance still reaches.  A lone point far from a dense cluster so reads a few
leaves of it, not the cluster.  Askers of a leaf are split into lots of
``LOT`` with a copy of the leaf each, so no task holds more than a lot and a leaf.
Box distances are computed like point distances (same operations, same
order), so rounding never lets a box seem farther than a point in it.

Each round is checkpointed to the shared folder (lineage cut, executor-loss
safe).  Rows with a NULL class or a NULL, NaN or infinite sensor have no
neighbours and are nobody's neighbour.
"""

from __future__ import annotations

from functools import reduce
from typing import List, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

LEAF_POINTS = 8192
SAMPLE = 1 << 18       # points of the sample, all classes together
MIN_SAMPLE = 16        # sampled points of a leaf, at least
FIRST_ASK = 8
LOT = 1 << 15
BLOCK = 256            # points of a block inside a leaf
_HASH_RANGE = 1 << 30


def distinct_points(df: DataFrame, k: int, label: str, key: str, feats: Sequence[str], classes) -> DataFrame:
    """One row per class and distinct sensors: the k + 1 smallest ids."""
    finite = [F.abs(F.col(f).cast("double")) < float("inf") for f in feats]
    rows = df.where(reduce(lambda a, b: a & b, finite) & F.col(label).isNotNull())
    if classes is not None:
        rows = rows.where(F.col(label).isin(list(classes)))
    rows = rows.select(F.col(key).alias("_id"), F.col(label).alias("_c"),
                       *[F.col(f).cast("double").alias(f) for f in feats])
    # the rank limit is applied before the shuffle too: a hot point sends k + 1 rows a task
    first = Window.partitionBy("_c", *feats).orderBy("_id")
    return (rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
            .groupBy("_c", *feats).agg(F.array_sort(F.collect_list("_id")).alias("_ids"))
            .withColumn("_rep", F.col("_ids")[0]))


class Splits:
    """The k-d splits of all classes; a negative child ``-(leaf + 1)`` is a leaf."""

    def __init__(self, samples: List[np.ndarray], sizes: List[int], leaf_points: int):
        self.axis, self.cut, self.left, self.right, self.leaf_class = [], [], [], [], []
        self.roots = np.array([self._grow(x, float(n), c, leaf_points) for c, (x, n) in enumerate(zip(samples, sizes))],
                              dtype=np.int64)
        self.axis, self.left, self.right = (np.array(a, dtype=np.int64) for a in (self.axis, self.left, self.right))
        self.cut, self.leaf_class = np.array(self.cut), np.array(self.leaf_class, dtype=np.int64)

    def _grow(self, x: np.ndarray, n: float, c: int, leaf_points: int) -> int:
        wide = int(np.argmax(x.max(axis=0) / 2 - x.min(axis=0) / 2)) if len(x) else 0
        v = x[:, wide]
        if n <= leaf_points or len(x) < 2 * MIN_SAMPLE or v.min() == v.max():
            self.leaf_class.append(c)
            return -len(self.leaf_class)
        at = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
        if at == v.max():
            at = v[v < at].max()
        node = len(self.axis)
        for held, value in zip((self.axis, self.cut, self.left, self.right), (wide, at, 0, 0)):
            held.append(value)
        low = v <= at
        self.left[node] = self._grow(x[low], n * low.mean(), c, leaf_points)
        self.right[node] = self._grow(x[~low], n * (1 - low.mean()), c, leaf_points)
        return node

    def leaves(self, cls: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The leaf of each point of ``x``."""
        at = self.roots[cls]
        while True:
            inner = np.flatnonzero(at >= 0)
            if not len(inner):
                return -at - 1
            node = at[inner]
            at[inner] = np.where(x[inner, self.axis[node]] <= self.cut[node], self.left[node], self.right[node])


def _matrix(table, feats: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(table.column(f).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch)
                                       else table.column(f).to_numpy(), dtype=np.float64) for f in feats])


def _squares(gaps) -> np.ndarray:
    return reduce(lambda a, b: a + b, [g * g for g in gaps])


def _box_distance(lo, hi, box_lo, box_hi) -> np.ndarray:
    """Squared distance of boxes (or points, where ``lo`` is ``hi``) to boxes, by the last axis but one."""
    return _squares([np.maximum(np.maximum(box_lo[:, j] - hi[..., j, None], lo[..., j, None] - box_hi[:, j]), 0.0)
                     for j in range(box_lo.shape[1])])


def _blocks(x: np.ndarray, size: int) -> List[np.ndarray]:
    """Points cut at medians of their widest axis into blocks of at most ``size``."""
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        i = todo.pop()
        if len(i) <= size:
            out.append(i)
            continue
        part = x[i]
        wide = int(np.argmax(part.max(axis=0) / 2 - part.min(axis=0) / 2))
        order = np.argpartition(part[:, wide], len(i) // 2)
        todo += [i[order[len(i) // 2:]], i[order[:len(i) // 2]]]
    return out


def nearest_in(q: np.ndarray, reach: np.ndarray, p: np.ndarray, k: int):
    """For each row of ``q`` its up to ``k`` nearest rows of ``p`` within the
    squared distance ``reach``, ties by row of ``p``: (row of q, row of p, d2),
    sorted by row of q, then distance."""
    blocks = _blocks(p, BLOCK)
    lo = np.array([p[b].min(axis=0) for b in blocks]).reshape(-1, p.shape[1])
    hi = np.array([p[b].max(axis=0) for b in blocks]).reshape(-1, p.shape[1])
    rows, cols, dist = [], [], []
    for mine in _blocks(q, BLOCK):
        x, r = q[mine], reach[mine].copy()
        best = np.full((len(mine), k), np.inf)
        bound = _box_distance(x.min(axis=0), x.max(axis=0), lo, hi)
        for b in np.argsort(bound, kind="stable"):
            if bound[b] > r.max():
                break
            near = np.flatnonzero(_box_distance(x, x, lo[b:b + 1], hi[b:b + 1])[:, 0] <= r)
            if not len(near):
                continue
            d = _squares([x[near, j, None] - p[blocks[b], j] for j in range(p.shape[1])])
            best[near] = np.partition(np.concatenate([best[near], d], axis=1), k - 1, axis=1)[:, :k]
            r[near] = np.minimum(r[near], best[near].max(axis=1))
            i, j = np.nonzero(d <= r[near, None])
            rows.append(mine[near[i]])
            cols.append(blocks[b][j])
            dist.append(d[i, j])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, d = np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    keep = rank < k
    return i[keep], j[keep], d[keep]


def _answer(asks: pa.Table, points: pa.Table, feats: Sequence[str], k: int, extra: Sequence[str]) -> pa.Table:
    """Askers with ``_near``: their nearest points (d2, ids, sensors) in the leaf."""
    points = points.sort_by("_rep").combine_chunks()
    i, j, d = nearest_in(_matrix(asks, feats), np.asarray(asks.column("_r2").to_numpy(), dtype=np.float64),
                         _matrix(points, feats), k)
    off = np.searchsorted(i, np.arange(asks.num_rows + 1)).astype(np.int32)
    got = points.select(["_ids", *feats]).take(pa.array(j)).combine_chunks()
    cols = [pa.array(d), *[_whole(got.column(c)) for c in got.column_names]]
    near = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(cols, ["d2", "ids", *feats]))
    return pa.table({**{c: asks.column(c) for c in extra}, "_near": near})


def _whole(col: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)


def _ask_batches(boxes, feats: Sequence[str], ask: int):
    """Waiting points to (point, leaf) for the next ``ask`` leaves within reach."""
    def run(batches):
        lo, hi, leaf_class = boxes.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, feats)
            own = b.column("_leaf").to_numpy()
            seen = b.column("_seen").to_numpy()
            r2 = b.column("_r2").to_numpy()
            row, leaf = [], []
            for home in np.unique(own):
                at = np.flatnonzero(own == home)
                other = np.flatnonzero(leaf_class == leaf_class[home])
                other = other[other != home]
                far = _box_distance(x[at].min(axis=0), x[at].max(axis=0), lo[other], hi[other])
                other = other[far <= r2[at].max()]     # no point of this leaf reaches the rest
                for part in np.array_split(at, -(-len(at) // BLOCK)) if len(other) else ():
                    d = _box_distance(x[part], x[part], lo[other], hi[other])
                    order = np.argsort(d, axis=1, kind="stable")   # by distance, then leaf: the same in every round
                    place = np.arange(len(other))
                    turn = ((place >= seen[part, None]) & (place < seen[part, None] + ask)
                            & (np.take_along_axis(d, order, axis=1) <= r2[part, None]))
                    i, j = np.nonzero(turn)
                    row.append(part[i])
                    leaf.append(other[order[i, j]])
            if row:
                at = pa.array(np.concatenate(row))
                keep = [c for c in b.schema.names if c not in ("_leaf", "_seen")]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep],
                                                  pa.array(np.concatenate(leaf), pa.int64())], [*keep, "_ask"])
    return run


def _partition(pts: DataFrame, feats: Sequence[str], leaf_points: int):
    """(points with ``_leaf``, leaf boxes and classes): splits from the
    sample, then one aggregate of the leaves' true boxes."""
    spark = pts.sparkSession
    sizes = pts.groupBy("_c").count().orderBy("_c").collect()  # one row per class
    share = SAMPLE / max(1, len(sizes))
    dims = spark.createDataFrame([(r["_c"], i, min(_HASH_RANGE, int(_HASH_RANGE * share / r["count"]) + 1))
                                  for i, r in enumerate(sizes)], f"_c {dict(pts.dtypes)['_c']}, _k int, _cut long")
    pts = pts.join(F.broadcast(dims), "_c")
    drawn = (pts.where(F.pmod(F.xxhash64(*feats), F.lit(_HASH_RANGE)) < F.col("_cut"))
             .select("_k", *feats).toPandas())          # SAMPLE points, about
    samples = [drawn.loc[drawn["_k"] == i, list(feats)].to_numpy(dtype=np.float64) for i in range(len(sizes))]
    splits = spark.sparkContext.broadcast(Splits(samples, [r["count"] for r in sizes], leaf_points))

    def place(batches):
        for b in batches:
            leaf = splits.value.leaves(b.column("_k").to_numpy(), _matrix(b, feats))
            keep = [c for c in b.schema.names if c not in ("_k", "_cut")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(leaf, pa.int64())], [*keep, "_leaf"])

    kept = pts.drop("_k", "_cut")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", _leaf bigint"
    leafed = pts.mapInArrow(place, schema).checkpoint(eager=True)
    n = len(splits.value.leaf_class)
    lo, hi = np.full((n, len(feats)), np.inf), np.full((n, len(feats)), -np.inf)   # a leaf without points is never near
    edges = leafed.groupBy("_leaf").agg(*[F.min(f).alias(f"lo{i}") for i, f in enumerate(feats)],
                                        *[F.max(f).alias(f"hi{i}") for i, f in enumerate(feats)])
    for r in edges.collect():                           # one row per leaf
        lo[r["_leaf"]] = [r[f"lo{i}"] for i in range(len(feats))]
        hi[r["_leaf"]] = [r[f"hi{i}"] for i in range(len(feats))]
    return leafed, (lo, hi, splits.value.leaf_class)


def neighbor_lists(df: DataFrame, k: int, label: str, key: str, feats: Sequence[str], classes=None,
                   leaf_points: int = LEAF_POINTS) -> DataFrame:
    """One row per class ``_c`` and distinct sensors: ``_nn``, the k + 1
    nearest rows of the class (d2, id, sensors) in order, ties by id, its own
    rows among them (at d2 = 0), and ``_leaves``, the leaves it was compared
    with.  Classes of fewer rows give all of them; no rows give no lists."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    pts = distinct_points(df, k, label, key, feats, classes).checkpoint(eager=True)
    types = dict(pts.dtypes)
    leafed, (lo, hi, leaf_class) = _partition(pts, feats, leaf_points)
    boxes = spark.sparkContext.broadcast((lo, hi, leaf_class))
    point = "struct<d2:double,ids:" + types["_ids"] + "".join(f",`{f}`:double" for f in feats) + ">"
    rep = f"_rep {types['_rep']}"
    sensors = ", ".join(f"`{f}` double" for f in feats)

    def own(table: pa.Table) -> pa.Table:
        asks = table.append_column("_r2", pa.array(np.full(table.num_rows, np.inf)))
        return _answer(asks, table, feats, k + 1, ["_c", "_rep", "_leaf", *feats])

    rows = F.flatten(F.transform("_near", lambda x: F.transform(
        x["ids"], lambda i: F.struct(x["d2"].alias("d2"), i.alias("id"), *[x[f].alias(f) for f in feats]))))
    reach = F.when(F.size("_nn") > k, F.element_at("_nn", -1)["d2"]).otherwise(F.lit(float("inf")))
    state = (leafed.groupBy("_leaf").applyInArrow(own, f"_c {types['_c']}, {rep}, _leaf bigint, {sensors}, _near array<{point}>")
             .withColumn("_nn", F.slice(F.array_sort(rows), 1, k + 1)).drop("_near")
             .withColumns({"_r2": reach, "_seen": F.lit(0).cast("long"), "_leaves": F.lit(1).cast("long")})
             .checkpoint(eager=True))
    widest = int(np.bincount(leaf_class).max()) - 1 if len(leaf_class) else 0   # leaves beside a point's own
    seen, ask = 0, FIRST_ASK
    done: List[DataFrame] = []
    while seen < widest:
        asks = (state.select("_c", "_rep", "_leaf", "_seen", "_r2", *feats)
                .mapInArrow(_ask_batches(boxes, feats, ask), f"_c {types['_c']}, {rep}, _r2 double, {sensors}, _ask bigint")
                .checkpoint(eager=True))
        lots = asks.groupBy("_ask").agg(F.ceil(F.count(F.lit(1)) / LOT).alias("_lots")).checkpoint(eager=True)
        if lots.isEmpty():
            break
        # one row per leaf: bounded, broadcast
        lots = F.broadcast(lots)
        copies = (leafed.withColumnRenamed("_leaf", "_ask").join(lots, "_ask")
                  .withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1))).drop("_lots"))
        dealt = asks.join(lots, "_ask").withColumn("_lot", F.pmod(F.xxhash64("_rep"), "_lots")).drop("_lots")
        got = (dealt.groupBy("_ask", "_lot").cogroup(copies.groupBy("_ask", "_lot"))
               .applyInArrow(lambda a, p: _answer(a, p, feats, k + 1, ["_c", "_rep"]),
                             f"_c {types['_c']}, {rep}, _near array<{point}>")
               .withColumn("_new", rows).groupBy("_c", "_rep")
               .agg(F.slice(F.array_sort(F.flatten(F.collect_list("_new"))), 1, k + 1).alias("_new"),
                    F.count(F.lit(1)).alias("_asked")))
        met = state.join(got, ["_c", "_rep"], "left").withColumn("_more", F.col("_asked").isNotNull())
        met = (met.withColumn("_nn", F.when(F.col("_more"), F.slice(F.array_sort(F.concat("_nn", "_new")), 1, k + 1))
                              .otherwise(F.col("_nn")))
               .withColumns({"_r2": reach, "_seen": F.lit(seen + ask).cast("long"),
                             "_leaves": F.col("_leaves") + F.coalesce("_asked", F.lit(0))})
               .drop("_new", "_asked").checkpoint(eager=True))
        # who had no leaf within reach has none later: the order is by distance and reach only shrinks
        done.append(met.where(~F.col("_more")))
        state = met.where("_more").drop("_more")
        seen, ask = seen + ask, 2 * ask
    lists = reduce(DataFrame.unionByName, [d.drop("_more") for d in done], state)
    return lists.select("_c", *feats, "_nn", "_leaves")
