"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only at anchors.  The 64 bits are cut into three
parts (22, 21, 21 bits), each padded to the 23 bits of the binary Golay code,
a perfect covering code of radius 3: every word has exactly one codeword (its
home anchor) within 3.  Two fingerprints within 4 bits differ by at most 1
bit in some part (``parts=1``), or by at most 2 bits in some two parts
(``parts=2``).  So each fingerprint is replicated to every anchor of each part
within covering radius plus that threshold, and each is compared, at its home
anchor, with all that came there: no link is lost (exact, not approximate).

Sizes: ``parts=1`` has 3 x 4,096 anchors and about 16 rows a fingerprint;
``parts=2`` has 3 x 2^24 anchors and about 180 rows, for very many
fingerprints.  Both give the same links; the choice follows the number of
distinct fingerprints.

Equal fingerprints are collapsed first.  A crowded anchor is cut into tiles of
bounded size, and a tile returns a spanning forest of its links (fewer rows
than fingerprints), so a large group of near copies never becomes all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, slices, sorted_groups, text_hash, texts

GOLAY = 0b110001110101          # generator polynomial of the (23, 12) Golay code
RADIUS = 3                      # its covering radius
PARTS = ((42, 22), (21, 21), (0, 21))  # shift and width of the three parts
TILE = 4096                     # rows of a side in one comparison
FINE_FROM = 1 << 24             # distinct fingerprints from which parts=2 is used
CHUNK_WORDS = 1 << 17

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of a text: a bit is 1 if set in over half of the shingles'
    XXH64 values (seed 42).  No words: 0; fewer words than a shingle has:
    one shingle of all."""
    words = text.lower().split() if text else []
    n = len(words)
    if n == 0:
        return 0
    k = min(shingle, n)
    total = n - k + 1
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, total, CHUNK_WORDS):
        part = words[at:at + CHUNK_WORDS + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        m = len(part) - k + 1
        h = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in
                                    zip(starts[:m].tolist(), ends[k - 1:].tolist())]),
                          np.uint8).reshape(m, 8)
        if m < 64:
            counts += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(h[:, p], minlength=256) @ _BITS for p in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _fingerprint_batches(shingle: int):
    def run(batches):
        for b in slices(batches, "_text"):
            fp = np.array([fingerprint(t, shingle) for t in texts(b.column("_text"))], dtype=np.uint64)
            cols = [b.column(n) for n in b.schema.names if n != "_text"]
            names = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp.view(np.int64))], [*names, "_fp"])
    return run


# ---------------------------------------------------------------- anchors

def _mod(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GOLAY << (bit - 11)
    return v


_COSETS: dict[int, tuple] = {}


def _cosets(extra: int) -> tuple:
    if extra not in _COSETS:
        _COSETS[extra] = _make_cosets(extra)
    return _COSETS[extra]


def _make_cosets(extra: int) -> tuple:
    """By syndrome: the error patterns of weight up to RADIUS + extra, the
    lightest first, as (offsets, patterns, excess over the covering radius)."""
    unit = [_mod(1 << i) for i in range(23)]
    hi = np.zeros(1 << 11, dtype=np.int64)
    lo = np.zeros(1 << 12, dtype=np.int64)
    for i in range(23):
        t, j = (lo, i) if i < 12 else (hi, i - 12)
        t[(np.arange(len(t)) >> j & 1) == 1] ^= unit[i]
    by: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for w in range(RADIUS + extra + 1):
        for c in combinations(range(23), w):
            s = e = 0
            for i in c:
                s ^= unit[i]
                e |= 1 << i
            by[s].append((e, max(0, w - RADIUS)))
    off = np.concatenate(([0], np.cumsum([len(x) for x in by])))
    return (lo, hi, off, np.array([e for x in by for e, _ in x], dtype=np.int64),
            np.array([x for y in by for _, x in y], dtype=np.int64))


def _expand(words: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of all anchors within RADIUS + extra of each word;
    excess 0 is the home anchor (the code is perfect, so there is one)."""
    lo, hi, off, pat, exc = _cosets(extra)
    syn = lo[words & 0xFFF] ^ hi[words >> 12]
    n = off[syn + 1] - off[syn]
    row = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[syn], n)
    return row, (words[row] ^ pat[at]) >> 11, exc[at]


def anchor_rows(fps: np.ndarray, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint row, anchor key, is home) for an array of uint64."""
    cut = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in PARTS]
    out = []
    for c, chosen in enumerate(combinations(range(3), parts)):
        row, key, exc = _expand(cut[chosen[0]], parts)
        if parts == 2:
            sub, key2, exc2 = _expand(cut[chosen[1]][row], parts)
            row, key, exc = row[sub], key[sub] << 12 | key2, exc[sub] + exc2
            ok = exc <= parts
            row, key, exc = row[ok], key[ok], exc[ok]
        out.append((row, key | c << 24, exc == 0))
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchor_batches(parts: int):
    step = 50_000 if parts == 1 else 5_000

    def run(batches):
        for b in batches:
            fps = b.column("_fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), step):
                f = fps[at:at + step]
                row, key, home = anchor_rows(f, parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(f[row].view(np.int64)), pa.array(home)],
                    ["_key", "_fp", "_home"])
    return run


# ---------------------------------------------------------------- comparison

def tile_links(home: np.ndarray, other: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sets of fingerprints, as
    pairs (smaller, larger) of signed 64-bit values."""
    nodes, inv = np.unique(np.concatenate((home, other)), return_inverse=True)
    hi, oi = inv[:len(home)], inv[len(home):]
    u = nodes.view(np.uint64)
    label = np.arange(len(nodes))
    out = []
    step = max(1, (1 << 20) // max(1, len(oi)))
    for at in range(0, len(hi), step):
        near = np.bitwise_count(u[hi[at:at + step]][:, None] ^ u[oi][None, :]) <= bits
        near &= hi[at:at + step][:, None] != oi[None, :]
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            i = hi[at + r]
            found = np.unique(np.append(label[oi[near[r]]], label[i]))
            if len(found) > 1:
                label[np.isin(label, found[1:])] = found[0]
                out += [(int(nodes[found[0]]), int(nodes[x])) for x in found[1:]]
    return out


def _link_batches(bits: int):
    def run(batches):
        a, b = [], []
        for _, g in sorted_groups(batches, ["_key", "_th", "_to"]):
            home = g["_fp"][g["_side"] == 0]
            other = g["_fp"][g["_side"] == 1]
            if len(home) and len(other) > 1:
                for x, y in tile_links(home, other, bits):
                    a.append(x)
                    b.append(y)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def fingerprint_links(fps: DataFrame, bits: int, parts: int) -> DataFrame:
    """Links (a, b) that connect what differs by at most ``bits`` (4 at most)
    among the distinct ``_fp``; a spanning set of the links, not all pairs."""
    if not 0 <= bits <= 4:
        raise ValueError("the three-part cover proves links up to 4 bits")
    keyed = fps.select("_fp").mapInArrow(_anchor_batches(parts), "_key long, _fp long, _home boolean")
    crowd = (keyed.groupBy("_key")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_home").cast("long")).alias("h"))
             .filter(F.col("n") > TILE)
             .select("_key", F.ceil(F.col("n") / TILE).cast("int").alias("_so"),
                     F.ceil(F.greatest("h", F.lit(1)) / TILE).cast("int").alias("_sh")))
    so, sh = F.coalesce("_so", F.lit(1)), F.coalesce("_sh", F.lit(1))
    t_other = F.pmod(F.xxhash64("_fp"), so).cast("int")
    t_home = F.pmod(F.xxhash64(F.lit(1), "_fp"), sh).cast("int")
    seat = lambda th, to, side: F.struct(th.alias("_th"), to.alias("_to"),
                                         F.lit(side).cast("byte").alias("_side"))
    others = F.transform(F.sequence(F.lit(0), sh - 1), lambda i: seat(i, t_other, 1))
    homes = F.when(F.col("_home"), F.transform(F.sequence(F.lit(0), so - 1), lambda i: seat(t_home, i, 0)))
    tiled = (keyed.join(crowd, "_key", "left")
             .select("_key", "_fp", F.inline(F.concat(others, F.coalesce(homes, F.slice(others, 1, 0))))))
    return (tiled.repartition("_key", "_th", "_to").sortWithinPartitions("_key", "_th", "_to")
            .select("_key", "_th", "_to", "_fp", "_side")
            .mapInArrow(_link_batches(bits), "a long, b long").distinct())


# ---------------------------------------------------------------- components

def components(links: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node reachable, for the nodes of
    ``links`` (a, b), by alternating large-star and small-star steps until
    nothing changes (about the logarithm of the longest chain)."""
    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = checkpointed(links.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
                         .select("a", "b").distinct())
    was = state(edges)
    while was[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = checkpointed(small)
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


# ---------------------------------------------------------------- operator

def _members(df: DataFrame, id_col: str, text_col: str, bits: int, shingle: int,
             parts: int | None) -> DataFrame:
    """(_id, _h, _fp, _root): one row per input row."""
    rows = checkpointed(df.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_h"),
                                  F.col(text_col).alias("_text"))
                        .mapInArrow(_fingerprint_batches(shingle),
                                    f"_id {df.schema[id_col].dataType.simpleString()}, _h long, _fp long"))
    fps = rows.groupBy("_fp").agg(F.min("_id").alias("_low"))
    fps = checkpointed(fps)
    n = fps.count()
    roots = components(fingerprint_links(fps, bits, parts or (1 if n < FINE_FROM else 2)))
    fps = fps.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left") \
             .select("_fp", "_low", F.coalesce("root", "_fp").alias("_root"))
    least = fps.groupBy("_root").agg(F.min("_low").alias("_component"))
    return rows.join(fps.join(least, "_root").select("_fp", "_root", "_component"), "_fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4,
                    shingle: int = 4, parts: int | None = None) -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` (16 hex digits) and
    ``component_id`` (the smallest id reachable over links of at most
    ``bits`` differing bits).

    Null and empty texts have fingerprint zero and link like any other.  Null
    ids are rows like others, but never a component's id unless all its ids
    are null.  Repeated rows each give a row.  Other columns are not read.
    """
    m = _members(df, id_col, text_col, bits, shingle, parts)
    return m.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                    F.col("_component").alias("component_id"))


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4,
                  shingle: int = 4, parts: int | None = None) -> DataFrame:
    """The rows of ``df`` (all columns) with one row for each component: that
    of the smallest id (null ids last), then of the smallest text hash."""
    m = _members(df, id_col, text_col, bits, shingle, parts)
    best = (m.groupBy("_root")
            .agg(F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("i"), F.col("_h").alias("h")))
                 .alias("w")).select(F.col("w.i").alias("__lm_i"), F.col("w.h").alias("__lm_wh")))
    twice = (m.groupBy("_id", "_h").count())
    best = best.join(twice.select(F.col("_id").alias("_ti"), F.col("_h").alias("_thash"), "count"),
                     F.col("__lm_i").eqNullSafe(F.col("_ti")) & (F.col("__lm_wh") == F.col("_thash"))) \
               .select("__lm_i", "__lm_wh", F.col("count").alias("__lm_copies"))
    best = checkpointed(best)
    d = df.withColumn("__lm_dh", text_hash(F.col(text_col)))
    kept = d.join(best, d[id_col].eqNullSafe(F.col("__lm_i")) & (F.col("__lm_dh") == F.col("__lm_wh")))
    single = kept.filter("__lm_copies = 1").select(*[kept[c] for c in df.columns])
    many = kept.filter("__lm_copies > 1").dropDuplicates(["__lm_i", "__lm_wh"]).select(*[kept[c] for c in df.columns])
    return single.union(many)
