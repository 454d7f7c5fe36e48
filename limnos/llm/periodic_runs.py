"""Periodic runs of words: maximal stretches that repeat with their smallest
period at least ``MIN_TIMES`` times, and texts without the repetitions.

Documents become arrays of word numbers.  A document is exploded into
overlapping tiles, a series for each band of period octaves (longer periods,
longer tiles), and the tiles of long documents are dealt over the cluster; a
document that is one tile is solved where it is read.

Within a tile, the octave of periods ``T/2 <= q < T`` has a boundary at every
multiple of ``T``.  A run of such a period holds a boundary and the ``T/2``
words after it twice, q words apart, so only those periods are looked at whose
block after a boundary recurs (compared by hashes of stretches, all boundaries
and periods at once); the Z-function values of the boundary, forward and
backward, confirm them and give the interval.  Tiles overlap by ``MIN_TIMES``
of their longest period, so the intervals cut off at their edges overlap by a
period at least: they shuffle by (document, period) and are stitched.  Of equal
intervals the one of the smallest period is the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shared_path, slices, texts

MIN_TIMES = 4            # a run holds its period this often ...
MIN_WORDS = 6            # ... and has this many words
SMALL = 8                # periods below are compared word by word
TILE_PERIODS = 1 << 12   # the first band of tiles holds the periods below this
BAND = 16                # each further band reaches this many times further
STRIDE = 16              # a tile's own words, in multiples of its band's longest period
SLICE = 4 << 20          # bytes of text taken into one array
BLOCK = 1 << 20          # (boundary, period) pairs compared at a time
_STEP = np.uint64(0x9E3779B97F4A7C15)

Edit = Callable[[object, list], list]


def needed(period):
    """Words that a run of the period has at least."""
    return np.maximum(MIN_WORDS, MIN_TIMES * period)


# ---------------------------------------------------------------- solving a tile

class Blocks:
    """Polynomial hashes of all stretches of a word array: equal stretches have
    equal hashes; the converse is always checked on the words."""

    def __init__(self, x: np.ndarray):
        z = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + _STEP
        z ^= z >> np.uint64(29)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(32)
        power = np.full(len(x) + 1, _STEP)
        power[0] = 1
        self.power = np.cumprod(power)
        self.sum = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(z * self.power[:-1], out=self.sum[1:])

    def alike(self, at, size, shift) -> np.ndarray:
        """Whether x[at : at + size] may equal the stretch ``shift`` words later."""
        here = self.sum[at + size] - self.sum[at]
        return here * self.power[shift] == self.sum[at + shift + size] - self.sum[at + shift]


def z_forward(x: np.ndarray, c: int, q: int) -> int:
    """How many words from c on equal those q later."""
    got, n, step = 0, len(x) - c - q, 64
    while got < n:
        to = min(n, got + step)
        differ = np.flatnonzero(x[c + got:c + to] != x[c + q + got:c + q + to])
        if len(differ):
            return got + int(differ[0])
        got, step = to, min(4 * step, 1 << 20)
    return max(0, got)


def z_backward(x: np.ndarray, c: int, q: int) -> int:
    """How many words before c equal those q later."""
    got, step = 0, 64
    while got < c:
        to = min(c, got + step)
        differ = np.flatnonzero(x[c - to:c - got] != x[c - to + q:c - got + q])
        if len(differ):
            return to - 1 - int(differ[-1])
        got, step = to, min(4 * step, 1 << 20)
    return got


def _small(x: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    same = np.zeros(max(0, len(x) - q) + 2, dtype=np.int8)
    same[1:-1] = x[:-q] == x[q:]
    turn = np.flatnonzero(same[1:] != same[:-1])
    start, end = turn[::2], turn[1::2] + q
    keep = end - start >= needed(q)
    return [(q, s, e) for s, e in zip(start[keep].tolist(), end[keep].tolist())]


def _block_period(x: np.ndarray, blocks: Blocks, c: int, half: int) -> int:
    """Smallest period up to half / 2 of the block at c; 0 if there is none."""
    p = np.arange(1, half // 2 + 1)
    for q in p[blocks.alike(np.full(len(p), c), half - p, p)].tolist():
        if np.array_equal(x[c:c + half - q], x[c + q:c + half]):
            return q
    return 0


def _octave(x: np.ndarray, longest: np.ndarray, blocks: Blocks, t: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Stretches long enough with a period in [lo, hi), within t/2 to t."""
    half, periods = t // 2, np.arange(lo, hi)
    c_all = np.arange(0, max(0, len(x) - half - lo + 1), t)
    c_all = c_all[longest[c_all] >= lo]
    out: list[tuple[int, int, int]] = []
    done: dict[int, int] = {}              # period: end of its last stretch
    zone, zone_end, zone_period = 0, 0, 0  # the last stretch whose period is short against the block
    rows = max(1, BLOCK // len(periods))
    for i in range(0, len(c_all), rows):
        c = c_all[i:i + rows]
        at, q = np.repeat(c, len(periods)), np.tile(periods, len(c))
        hit = np.flatnonzero((at + q + half <= len(x)) & (q <= longest[at]))
        hit = hit[blocks.alike(at[hit], half, q[hit])]
        at, q = at[hit], q[hit]
        for first in np.flatnonzero(np.diff(at, prepend=-1)).tolist():
            b = int(at[first])
            own = q[first:np.searchsorted(at, b, side="right")]
            if not (zone <= b and b + half <= zone_end):
                zone_period = _block_period(x, blocks, b, half) if len(own) > 1 else 0
                zone, zone_end = b, b + zone_period + z_forward(x, b, zone_period) if zone_period else 0
            if zone_period:                # blocks that recur in their own zone do so at multiples of its period
                own = own[(own % zone_period != 0) | (b + own + half > zone_end)]
            for k in own.tolist():
                if b + k < done.get(k, 0):
                    continue               # in the stretch of an earlier boundary
                ahead = z_forward(x, b, k)
                if ahead < half:
                    continue               # only the hashes agreed
                s, e = b - z_backward(x, b, k), b + k + ahead
                done[k] = e
                if e - s >= needed(k):
                    out.append((k, s, e))
    return out


def solve(x: np.ndarray, longest: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(periods, starts, ends) of the stretches of ``x`` that have a period in
    [lo, hi) and are long enough, each as far as it goes within ``x``; of equal
    stretches only that of the smallest period.  ``longest`` is the longest
    period looked for at each word (texts laid one after the other have words of
    their own between them)."""
    found: list[tuple[int, int, int]] = []
    top = min(hi - 1, int(longest.max(initial=0)))
    for q in range(lo, min(SMALL, top + 1)):
        found += _small(x, q)
    if top >= SMALL:
        blocks, t = Blocks(x), 2 * SMALL
        while t // 2 <= top:
            if t > lo:
                found += _octave(x, longest, blocks, t, max(lo, t // 2), min(hi, t))
            t *= 2
    best: dict[tuple[int, int], int] = {}
    for q, s, e in found:
        best[s, e] = min(q, best.get((s, e), q))
    a = np.array([(q, s, e) for (s, e), q in best.items()], dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


# ---------------------------------------------------------------- tiles

def bands(n: int) -> list[tuple[int, int]]:
    """Bands [lo, hi) of the periods that a document of n words may have."""
    out, lo, hi = [], 1, TILE_PERIODS
    while not out or MIN_TIMES * lo <= n:
        out.append((lo, hi))
        lo, hi = hi, hi * BAND
    return out


def tiles(n: int, hi: int) -> list[tuple[int, int]]:
    """Windows of a band's tiles: own words, and ``MIN_TIMES`` of the band's
    longest period on both sides."""
    step, edge = STRIDE * hi, MIN_TIMES * hi
    return [(max(0, a - edge), min(n, a + step + edge)) for a in range(0, max(1, n), step)]


_KINDS = {"kind": pa.int32(), "key": pa.int64(), "period": pa.int64(), "start": pa.int64(), "end": pa.int64(), "lo": pa.int64(),
          "hi": pa.int64(), "n_words": pa.int64(), "words": pa.binary(), "sha": pa.string()}
DOCUMENT, FRAGMENT, TILE = 0, 1, 2


def _batch(kind: int, id_type: pa.DataType, **cols) -> pa.RecordBatch:
    """Rows of one kind in the schema that all kinds share."""
    rows = len(cols["key"])
    types = {**_KINDS, "_id": id_type}
    arrays = [pa.array([kind] * rows, t) if n == "kind" else cols[n] if isinstance(cols.get(n), pa.Array)
              else pa.array(cols[n], t) if n in cols else pa.nulls(rows, t) for n, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, list(types))


def _scan_batches(edit: Edit | None, keep_text: bool):
    """Documents (their words only where they may hold a run, or all), fragments
    of documents of one tile, and tiles of longer ones."""
    def run(batches):
        task, seen = TaskContext.get().partitionId(), 0
        for b in slices(batches, "_text", SLICE):
            ids, kind = b.column("_id"), b.column("_id").type
            words = [t.split() if t else [] for t in texts(b.column("_text"))]
            if edit:
                words = [edit(i, w) for i, w in zip(ids.to_pylist(), words)]
            numbers: dict[bytes, int] = {}
            number = numbers.setdefault
            arrays = [np.array([number(v, len(numbers)) for v in w], dtype=np.int64) for w in words]
            size = np.array([len(a) for a in arrays], dtype=np.int64)
            key = (task << 32) + seen + np.arange(len(size), dtype=np.int64)
            seen += len(size)
            one = np.array([len(bands(n)) == 1 and len(tiles(n, TILE_PERIODS)) == 1 for n in size.tolist()], dtype=bool)
            short, held = np.flatnonzero(one), set(np.flatnonzero(~one).tolist())
            if len(short):
                x = np.concatenate([p for i in short.tolist() for p in (arrays[i], np.array([-1 - i]))])
                of = np.repeat(short, size[short] + 1)
                first = np.zeros(len(size), dtype=np.int64)
                first[short] = np.cumsum(size[short] + 1) - size[short] - 1
                q, s, e = solve(x, size[of] // MIN_TIMES, 1, TILE_PERIODS)
                of = of[s]
                held.update(of.tolist())
                if len(q):
                    yield _batch(FRAGMENT, kind, key=key[of], period=q, start=s - first[of], end=e - first[of])
            for i in np.flatnonzero(~one).tolist():
                n = int(size[i])
                for lo, hi in bands(n):
                    for a, z in tiles(n, hi):
                        yield _batch(TILE, kind, key=key[i:i + 1], start=[a], end=[z], lo=[lo], hi=[hi], n_words=[n],
                                     words=[arrays[i][a:z].astype(np.int32).tobytes()])
            joined = [b" ".join(w) for w in words]
            yield _batch(DOCUMENT, kind, key=key, _id=ids, n_words=size, sha=[hashlib.sha256(j).hexdigest() for j in joined],
                         words=[j if keep_text or i in held else None for i, j in enumerate(joined)])
    return run


def _solve_tiles(batches):
    for b in batches:
        for r in b.to_pylist():
            x = np.frombuffer(r["words"], dtype=np.int32).astype(np.int64)
            q, s, e = solve(x, np.full(len(x), r["n_words"] // MIN_TIMES), r["lo"], r["hi"])
            yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(q), pa.int64()), *map(pa.array, (q, s + r["start"], e + r["start"]))],
                                             ["key", "period", "start", "end"])


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (key, period, start, end) from the fragments of tiles: those of a
    document and period that overlap by a period are one interval, and equal
    intervals have the smallest of their periods."""
    by = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = fragments.withColumn("cut", (reach.isNull() | (F.col("start") > reach - F.col("period"))).cast("int"))
    return (cut.withColumn("part", F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("key", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("key", "start", "end").agg(F.min("period").alias("period")))


def _finish_batches(keep_text: bool):
    def run(batches):
        for b in slices(batches, "words", SLICE):
            sha, text = b.column("sha").to_pylist(), b.column("words").to_pylist()
            runs = b.column("runs").to_pylist()
            for i, own in enumerate(runs):
                if own:
                    w = np.array([*text[i].split(b" "), None], dtype=object)[:-1]
                    drop = np.zeros(len(w), dtype=bool)
                    for r in own:
                        drop[r["start"] + r["period"]:r["start"] + r["length"]] = True
                    text[i] = b" ".join(w[~drop].tolist())
                    sha[i] = hashlib.sha256(text[i]).hexdigest()
            cols = [b.column("_id"), b.column("n_words"), b.column("runs"), pa.array(sha, pa.string())]
            if keep_text:
                cols.append(pa.array(text, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["_id", "n_words", "runs", "collapsed_sha256", "collapsed"][:len(cols)])
    return run


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Edit | None = None,
              keep_text: bool = False) -> DataFrame:
    """One row per row of ``df``: id, ``n_words`` (``[^\\x20\\x09-\\x0D]+``),
    ``runs`` (structs of start, length and period, by start, then period) and
    ``collapsed_sha256``, the hash of the words joined by one space without
    those that some run holds after its first period; with ``keep_text`` also
    that text, ``collapsed_text``.  ``edit(id, words)`` may change a document's
    words before (as bytes, in the tasks).

    Null and empty texts have no words and no runs, and an empty text is their
    collapsed one.  Null ids are ids like others; repeated rows each give a row;
    an empty table gives none; other columns are not read.
    """
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    path = shared_path(spark, "periodic-runs")
    df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _scan_batches(edit, keep_text), "kind int, key long, period long, start long, end long, lo long, hi long, n_words long, "
                                        f"words binary, sha string, _id {id_type}").write.parquet(path)
    rows = spark.read.parquet(path)
    dealt = rows.filter(F.col("kind") == TILE).select("key", "start", "lo", "hi", "n_words", "words").repartition("key", "lo", "start")
    fragments = rows.filter(F.col("kind") == FRAGMENT).select("key", "period", "start", "end") \
                    .union(dealt.mapInArrow(_solve_tiles, "key long, period long, start long, end long"))
    run = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    runs = stitched(fragments).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", run.alias("run")))).alias("r")) \
                              .select(F.col("key").alias("of"), F.col("r.run").alias("runs"))
    docs = rows.filter(F.col("kind") == DOCUMENT).select("key", "_id", "n_words", "sha", "words")
    out = docs.join(runs, F.col("key") == F.col("of"), "left").select(
        "_id", "n_words", "sha", "words", F.coalesce("runs", F.array().cast("array<struct<start:long,length:long,period:long>>")).alias("runs"))
    schema = f"_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string"
    out = out.mapInArrow(_finish_batches(keep_text), schema + (", collapsed binary" if keep_text else ""))
    if keep_text:
        out = out.select("*", F.col("collapsed").cast("string").alias("collapsed_text")).drop("collapsed")
    return out.withColumnRenamed("_id", id_col)
