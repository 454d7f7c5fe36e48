"""Quality rules: an isolation forest on rule statistics.

Each document gets exact rule statistics.  A forest of random split trees is
grown on a fixed-size random subsample per tree (the method's own subsampling;
128 rows a tree), drawn by seeded hash from all documents that pass the base
rules.  There is one forest on the shares of characters and one on those of
repeats: 4 % of the good rows repeat a line, and in a common forest these
would use up the allowance.  The path length of every document gives its
anomaly scores, and each forest's threshold is calibrated on all labelled
rows: among the cuts that reject, with those of the forests before, at most
``max_loss`` of the good rows, the one with the largest share of bad rows
caught less the share of good rows lost.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, first_by_hash, flat, slices, sums, text_hash, texts, whitespace, word_counts

WINDOW = 8
MIN_WORDS = 20
REPEAT_PCT = 30
TREES, SUBSAMPLE, SEED = 100, 128, 42
MAX_LOSS = 0.01
BINS = 2000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
FORESTS = (("symbols", "marks", "upper", "word_length"), ("repeat", "dup_lines"))
FEATURES = tuple(f for own in FORESTS for f in own)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)


# ---------------------------------------------------------------- statistics

def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for x, n in Counter(lines).items() if n > 1 and x.strip())


def repeat_words(words: list[bytes]) -> int:
    """Words inside a WINDOW-word window that occurs twice or more (exact)."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    roll = h[:n] * _POWERS[0]
    for i in range(1, WINDOW):
        roll += h[i:n + i] * _POWERS[i]
    order = np.argsort(roll, kind="stable")
    same = roll[order[1:]] == roll[order[:-1]]
    if not same.any():
        return 0
    mark = np.zeros(n, dtype=bool)
    mark[order[1:][same]] = True
    mark[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(mark).tolist():
        seen.setdefault(tuple(words[i:i + WINDOW]), []).append(i)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for at in seen.values():
        if len(at) > 1:
            at = np.array(at)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def _stat_batches(batches):
    for b in slices(batches, "_text"):
        col = b.column("_text")
        buf, off = flat(col)
        ws = whitespace(buf)
        exact = [(dup_lines(t), repeat_words(t.split()), t.count(b"\n") + 1) if t else (0, 0, 0)
                 for t in texts(col)]
        dup, rep, lines = (np.array(x, dtype=np.int64) for x in zip(*exact))
        vals = {"n_words": word_counts(col), "word_chars": sums(~ws & ((buf & 0xC0) != 0x80), off),
                "n_symbols": sums(_SYMBOL[buf], off), "n_dup_lines": dup, "n_repeat_words": rep,
                "n_lines": lines, "n_upper": sums(_UPPER[buf], off), "n_marks": sums(_MARK[buf], off)}
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_h"), *[pa.array(vals[s]) for s in STATS]],
                                         ["_id", "_h", *STATS])


def rule_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, statistics..., base_failed) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
            .mapInArrow(_stat_batches, f"_id {kind}, _h long, " + ", ".join(f"{s} long" for s in STATS))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words"))))


def _features(df: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = {"repeat": F.col("n_repeat_words") / words, "symbols": F.col("n_symbols") / chars,
             "marks": F.col("n_marks") / words, "upper": F.col("n_upper") / chars,
             "word_length": F.log(F.col("word_chars") / words + 1), "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))}
    return df.select("*", *[share[f].alias(f"f_{f}") for f in FEATURES])


# ---------------------------------------------------------------- forest

def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree: nodes (feature, split, left, right, path length at a leaf)."""
    nodes: list = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(wide) == 0:
            nodes[at] = (-1, 0.0, at, at, depth + average_path(len(rows)))
            return at
        f = int(rng.choice(wide))
        lo, hi = rows[:, f].min(), rows[:, f].max()
        split = float(rng.uniform(lo, hi))
        if split <= lo:
            split = float(hi)
        left = rows[:, f] < split
        nodes[at] = (f, split, add(rows[left], depth + 1), add(rows[~left], depth + 1), 0.0)
        return at

    add(x, 0)
    return nodes


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> dict:
    rng = np.random.default_rng(seed)
    limit = max(1, math.ceil(math.log2(max(2, subsample))))
    grown = [grow(x[rng.choice(len(x), min(subsample, len(x)), replace=False)], rng, limit) for _ in range(trees)]
    base = np.cumsum([0, *map(len, grown)])[:-1]
    flatn = [(f, s, b + le, b + r, p) for b, t in zip(base.tolist(), grown) for f, s, le, r, p in t]
    f, s, le, r, p = (np.array(c) for c in zip(*flatn))
    return {"feature": f, "split": s, "left": le, "right": r, "path": p, "roots": base, "limit": limit,
            "norm": average_path(min(subsample, len(x))) or 1.0}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path length / expected): near 1 anomalous, under 0.5 ordinary."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for root in forest["roots"].tolist():
        at = np.full(len(x), root)
        for _ in range(forest["limit"]):
            f = forest["feature"][at]
            at = np.where(x[rows, f] < forest["split"][at], forest["left"][at], forest["right"][at])
        total += forest["path"][at]
    return 2.0 ** (-(total / len(forest["roots"])) / forest["norm"])


def _score_batches(forests: list[dict]):
    def run(batches):
        for b in batches:
            scores = []
            for own, forest in zip(FORESTS, forests):
                x = np.column_stack([b.column(f"f_{f}").to_numpy(zero_copy_only=False) for f in own]).astype(float)
                scores.append(pa.array(anomaly(forest, x) if len(x) else np.zeros(0)))
            keep = [n for n in b.schema.names if not n.startswith("f_")]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], *scores],
                                             [*keep, *[f"anomaly_{k}" for k in range(len(FORESTS))]])
    return run


# ---------------------------------------------------------------- operator

def _scored(df: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, label_col: str,
            max_loss: float, trees: int, subsample: int, seed: int) -> DataFrame:
    stats = checkpointed(rule_statistics(df, id_col, text_col))
    feats = _features(stats)
    cols = [f"f_{f}" for f in FEATURES]
    sample = first_by_hash(feats.filter("not base_failed").select("_id", "_h", *cols), F.xxhash64(F.lit(seed), "_id", "_h"),
                           trees * subsample, *cols).select(*cols).collect()
    if not sample:
        return feats.select("_id", "_h", *STATS, "base_failed", F.lit(0.0).alias("anomaly"), F.lit(False).alias("kept"))
    x = np.array(sample, dtype=float)
    forests = [grow_forest(x[:, [FEATURES.index(f) for f in own]], trees, subsample, seed) for own in FORESTS]
    kinds = [f.simpleString().replace(":", " ", 1) for f in stats.schema.fields]
    names = [f"anomaly_{k}" for k in range(len(FORESTS))]
    scored = checkpointed(feats.mapInArrow(_score_batches(forests), ", ".join([*kinds, *[f"{n} double" for n in names]])))
    kept = ~F.col("base_failed")
    for name, cut in zip(names, _thresholds(scored, names, labels, id_col, label_col, max_loss)):
        kept = kept & (F.col(name) <= cut)
    return scored.withColumn("anomaly", F.greatest(*names)).withColumn("kept", kept)


def _thresholds(scored: DataFrame, names: list[str], labels: DataFrame | None, id_col: str, label_col: str,
                max_loss: float) -> list[float]:
    """For each score in turn the cut with the largest share of bad rows above
    less that of good rows, among those with at most ``max_loss`` of the good
    rows above it or an earlier cut (of equal cuts the highest); without good
    and bad labels nothing is rejected by the scores."""
    if labels is None:
        return [1.0] * len(names)
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y")))
    rows = scored.filter("not base_failed").join(known, "_id")
    cuts, left = [], F.lit(True)                   # left: not above an earlier cut
    for name in names:
        bins = (rows.groupBy(F.floor(F.col(name) * BINS).cast("int").alias("bin"))
                .agg(F.count_if(F.col("y") >= 1).alias("all"), F.count_if((F.col("y") >= 1) & left).alias("good"),
                     F.count_if(F.col("y") < 1).alias("bad")).collect())
        n = np.zeros((3, BINS + 1))
        for r in bins:
            n[:, r["bin"]] += r["all"], r["good"], r["bad"]
        total, stay, bads = n.sum(axis=1)
        if not total or not bads:
            return [1.0] * len(names)
        good, bad = (stay - np.cumsum(n[1])) / total, 1 - np.cumsum(n[2]) / bads     # shares in higher bins
        gain = np.where(good + (total - stay) / total <= max_loss, bad - good, -1.0)
        cuts.append(float((BINS + 1 - int(np.argmax(gain[::-1]))) / BINS))
        left = left & (F.col(name) <= cuts[-1])
    return cuts


def isolation_rules(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", max_loss: float = MAX_LOSS, trees: int = TREES,
                    subsample: int = SUBSAMPLE, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, rule statistics, ``base_failed``,
    ``anomaly`` (the larger of the forests' scores) and ``kept``.

    Null text: all counts 0, base rule failed.  Null ids: scored like others,
    never matched to a label.  Repeated rows each give a row; of labels that
    disagree the worse counts.  Labels without both classes: only the base
    rules reject.  No document that passes the base rules, or an empty table:
    nothing is kept.  Other columns are not read.
    """
    s = _scored(df, labels, id_col, text_col, label_col, max_loss, trees, subsample, seed)
    return s.select(F.col("_id").alias(id_col), *STATS, "base_failed", "anomaly", "kept")


def keep_good(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", max_loss: float = MAX_LOSS, trees: int = TREES,
              subsample: int = SUBSAMPLE, seed: int = SEED) -> DataFrame:
    """The kept rows of ``df``, all columns (repeated rows are kept or dropped together)."""
    s = _scored(df, labels, id_col, text_col, label_col, max_loss, trees, subsample, seed)
    ok = s.filter("kept").select(F.col("_id").alias("__lm_i"), F.col("_h").alias("__lm_h")).distinct()
    d = df.withColumn("__lm_th", text_hash(F.col(text_col)))
    return d.join(ok, d[id_col].eqNullSafe(F.col("__lm_i")) & (F.col("__lm_th") == F.col("__lm_h")), "left_semi") \
            .drop("__lm_th")
