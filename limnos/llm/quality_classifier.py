"""Quality classifier by co-training of two views.

The text-content view is a naive Bayes model over hashed words and word
shapes; the page-metadata view one over source, language and layout facts
(lengths, lines, capitals, marks).  Both start from a bounded sample of the
labelled rows.  In each round one pass over all unlabelled documents lets each
view label those it is sure of, and these pseudo-labels train the other view; a
class's weigh at most ``PSEUDO`` of its labelled rows, so that easy documents do
not outvote them, and a round is kept only if the calibration rows' loss falls.
Views are calibrated on labelled rows that no model was fitted on, and a
logistic combination of the calibrated views scores every document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import first_by_hash, slices, texts

TEXT_BUCKETS = 1 << 16
META_BUCKETS = 1 << 12
ROUNDS = 2
CONFIDENT = 0.98
PSEUDO = 0.5           # most weight of a class's pseudo-labels against its labelled rows
MAX_FIT = 20_000       # most labelled rows a model is fitted on
MAX_CALIBRATE = 10_000 # most further labelled rows for calibration
SMOOTH = 1.0
SEED = 42
CACHE = 200_000        # distinct words a worker remembers

_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 0x80 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
               for c in range(256))
_DROP_BUT_MARKS = bytes(c for c in range(256) if c not in b"!?#*$%&|<>")
_DROP_BUT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)


class Features:
    """Hashed features of both views; words are remembered up to a bound."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.shapes: dict[bytes, int] = {}

    def _ids(self, tokens: list[bytes], cache: dict, salt: int) -> np.ndarray:
        get = cache.get
        out = [get(t, -1) for t in tokens]
        if -1 in out:
            if len(cache) > CACHE:
                cache.clear()
            for i, (t, x) in enumerate(zip(tokens, out)):
                if x < 0:
                    out[i] = cache[t] = zlib.crc32(t, salt) & (TEXT_BUCKETS - 1)
        return np.array(out, dtype=np.int64)

    def text(self, text: bytes | None) -> np.ndarray:
        """Distinct feature buckets of the content, empty for no words."""
        tokens = text.lower().split() if text else []
        if not tokens:
            return np.zeros(0, dtype=np.int64)
        w = self._ids(tokens, self.words, 0)
        s = self._ids(text.translate(_SHAPE).split(), self.shapes, 1)
        distinct = np.unique(w)
        share = int(10 * len(distinct) / len(w))
        special = [zlib.crc32(b"distinct %d %d" % (share, min(3, len(w).bit_length() // 3))) & (TEXT_BUCKETS - 1)]
        return np.unique(np.concatenate((distinct, s, special)))

    @staticmethod
    def meta(text: bytes | None, source, lang) -> np.ndarray:
        """Feature buckets of the page: source, language and layout facts in steps."""
        t = text or b""
        n = max(1, len(t))
        lines = t.count(b"\n") + 1
        marks, upper = len(t.translate(None, _DROP_BUT_MARKS)), len(t.translate(None, _DROP_BUT_UPPER))
        step = lambda k: min(20, int(200 * k / n))
        facts = (f"s{source}", f"l{lang}", f"n{len(t).bit_length()}", f"k{lines.bit_length()}",
                 f"w{(n // lines).bit_length()}", f"m{step(marks)}", f"u{step(upper)}")
        return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) & (META_BUCKETS - 1) for x in facts])


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Naive Bayes log-odds of each bucket from class counts (2 x buckets)."""
    c = counts.astype(float) + SMOOTH
    return np.log(c[1] / c[1].sum()) - np.log(c[0] / c[0].sum())


class View:
    """The log-odds of a view, with a logistic calibration (slope, offset) of
    a document's mean log-odds."""

    def __init__(self, odds: np.ndarray, calibration=(1.0, 0.0)):
        self.odds, self.calibration = odds, calibration

    def plain(self) -> tuple:
        """What a broadcast holds."""
        return self.odds, self.calibration

    def raw(self, ids: np.ndarray) -> float:
        return float(self.odds[ids].mean()) if len(ids) else 0.0

    def logit(self, ids: np.ndarray) -> float:
        return self.calibration[0] * self.raw(ids) + self.calibration[1]


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression with offset, by damped Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _emit(view: int, counts: np.ndarray):
    at = np.flatnonzero(counts.sum(axis=0))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), view, dtype=np.int32)), pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])],
        ["view", "bucket", "n0", "n1"])


def _label_counts(batches):
    """Class counts of both views from labelled rows."""
    f = Features()
    ct, cm = np.zeros((2, TEXT_BUCKETS), np.int64), np.zeros((2, META_BUCKETS), np.int64)
    for b in slices(batches, "_text"):
        for t, s, la, y in zip(texts(b.column("_text")), *(b.column(c).to_pylist() for c in ("_source", "_lang", "_y"))):
            ct[y, f.text(t)] += 1
            np.add.at(cm[y], f.meta(t, s, la), 1)
    yield _emit(0, ct)
    yield _emit(1, cm)


def _exchange_counts(held):
    """Class counts that each view gains from the other's confident labels."""
    def run(batches):
        (vt, vm), sure = (View(*v) for v in held.value[:2]), held.value[2]
        f = Features()
        ct, cm = np.zeros((2, TEXT_BUCKETS), np.int64), np.zeros((2, META_BUCKETS), np.int64)
        for b in slices(batches, "_text"):
            for t, s, la in zip(texts(b.column("_text")), b.column("_source").to_pylist(), b.column("_lang").to_pylist()):
                it, im = f.text(t), f.meta(t, s, la)
                lt, lm = vt.logit(it), vm.logit(im)
                if abs(lt) >= sure:
                    np.add.at(cm[int(lt > 0)], im, 1)
                if abs(lm) >= sure:
                    ct[int(lm > 0), it] += 1
        yield _emit(0, ct)
        yield _emit(1, cm)
    return run


def _raw_batches(held):
    def run(batches):
        vt, vm = (View(*v) for v in held.value)
        f = Features()
        for b in slices(batches, "_text"):
            got = [(vt.raw(f.text(t)), vm.raw(f.meta(t, s, la))) for t, s, la in
                   zip(texts(b.column("_text")), b.column("_source").to_pylist(), b.column("_lang").to_pylist())]
            x = np.array(got, dtype=float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), b.column("_y")], ["t", "m", "y"])
    return run


def _score_batches(held):
    def run(batches):
        (vt, vm), beta = (View(*v) for v in held.value[:2]), held.value[2]
        f = Features()
        prob = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for b in slices(batches, "_text"):
            x = np.array([(vt.logit(f.text(t)), vm.logit(f.meta(t, s, la))) for t, s, la in
                          zip(texts(b.column("_text")), b.column("_source").to_pylist(), b.column("_lang").to_pylist())],
                         dtype=float).reshape(-1, 2)
            none = np.array([not (t and t.strip()) for t in texts(b.column("_text"))], dtype=bool)
            score = np.where(none, 0.0, prob(x @ beta[:2] + beta[2]))
            yield pa.RecordBatch.from_arrays([b.column("_id"), *map(pa.array, (prob(x[:, 0]), prob(x[:, 1]), score, score >= 0.5))],
                                             ["_id", "p_text", "p_meta", "score", "kept"])
    return run


def _gather(rows: DataFrame, fn) -> list[np.ndarray]:
    """The two views' counts (the number of buckets bounds them)."""
    out = [np.zeros((2, TEXT_BUCKETS)), np.zeros((2, META_BUCKETS))]
    for r in rows.mapInArrow(fn, "view int, bucket long, n0 long, n1 long").groupBy("view", "bucket") \
                 .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        out[r["view"]][:, r["bucket"]] = r["n0"], r["n1"]
    return out


def co_train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             lang_col: str = "lang", label_col: str = "quality", rounds: int = ROUNDS, max_fit: int = MAX_FIT,
             max_calibrate: int = MAX_CALIBRATE, seed: int = SEED):
    """(text view, metadata view, weights of the combination), calibrated; None
    if the labelled rows don't show both classes."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("_source"),
                     F.col(lang_col).cast("string").alias("_lang"))
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.min((F.col(label_col) >= 1).cast("int")).alias("_y")))
    order = F.xxhash64(F.lit(seed), "_id")
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(3))
    fit = first_by_hash(known.filter(part > 0), order, max_fit, "_id")               # bounded, so it may be broadcast
    hold = first_by_hash(known.filter(part == 0), order, max_calibrate, "_id")
    base = _gather(rows.join(F.broadcast(fit), "_id"), _label_counts)
    if not base[1][0].sum() or not base[1][1].sum():
        return None
    held_rows = rows.join(F.broadcast(hold), "_id")

    def calibrated(counts):
        views = [View(log_odds(c)) for c in counts]
        got = held_rows.mapInArrow(_raw_batches(spark.sparkContext.broadcast([v.plain() for v in views])), "t double, m double, y int") \
            .groupBy(F.round("t", 2).alias("t"), F.round("m", 2).alias("m"), "y").count().collect()
        x = np.array([(r["t"], r["m"]) for r in got], dtype=float).reshape(-1, 2)
        y, w = np.array([r["y"] for r in got], dtype=float), np.array([r["count"] for r in got], dtype=float)
        if len(set(y.tolist())) < 2:
            return views, np.array([0.5, 0.5, 0.0]), np.inf
        logits = []
        for i, v in enumerate(views):
            v.calibration = tuple(fit_logistic(x[:, i:i + 1], y, w))
            logits.append(v.calibration[0] * x[:, i] + v.calibration[1])
        both = np.column_stack(logits)
        beta = fit_logistic(both, y, w)
        z = both @ beta[:2] + beta[2]
        return views, beta, float((w * (np.logaddexp(0, z) - y * z)).sum())

    views, beta, loss = calibrated(base)
    sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
    free = rows.join(F.broadcast(fit.select("_id").union(hold.select("_id"))), "_id", "left_anti")
    for _ in range(rounds):
        gained = _gather(free, _exchange_counts(spark.sparkContext.broadcast((*[v.plain() for v in views], sure))))
        share = [np.minimum(1.0, PSEUDO * b.sum(axis=1) / np.maximum(1, g.sum(axis=1))) for b, g in zip(base, gained)]
        after = calibrated([b + g * s[:, None] for b, g, s in zip(base, gained, share)])
        if not after[2] < loss:
            break
        views, beta, loss = after
    return views[0], views[1], beta


def classify_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     source_col: str = "source", lang_col: str = "lang", label_col: str = "quality",
                     rounds: int = ROUNDS, max_fit: int = MAX_FIT, max_calibrate: int = MAX_CALIBRATE,
                     seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, ``p_text`` and ``p_meta`` (calibrated
    views), ``score`` (their combination) and ``kept`` (score of 0.5 or more).

    Null texts and texts without words have score 0.  Null sources and
    languages are values of their own.  Null ids are scored, never matched to
    a label; of labels that disagree the worse counts; repeated rows each give
    a row.  Labels without both classes: every text with words is kept with
    score 1 and views of 0.5.  Other columns are not read.
    """
    model = co_train(df, labels, id_col, text_col, source_col, lang_col, label_col, rounds, max_fit, max_calibrate, seed)
    if model is None:
        model = (View(np.zeros(TEXT_BUCKETS)), View(np.zeros(META_BUCKETS)), np.array([0.0, 0.0, 500.0]))
    held = df.sparkSession.sparkContext.broadcast((model[0].plain(), model[1].plain(), model[2]))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("_source"),
                     F.col(lang_col).cast("string").alias("_lang"))
    return rows.mapInArrow(_score_batches(held), f"_id {kind}, p_text double, p_meta double, score double, kept boolean") \
               .withColumnRenamed("_id", id_col)
