"""Line dedup with two Bloom filters for each range of the hash space.

Pass 1 sends the 64-bit hashes of each document's distinct lines, aggregated
by slice of a task, to the task of their hash range.  It puts them into a filter
of what was seen once and, when they were there already, into a filter of what
was seen twice.  A range holds about as many lines as its filters are made for
(``BITS_PER_LINE``), so their rate of errors does not grow with the input, nor
does a task's memory (``MAX_RANGE_BITS``, twice), and what is shuffled does not
depend on the number of input partitions.  Pass 2 lets only lines of the second
filters (suspected repeats) shuffle as whole keys, for the exact count of
documents; confirmed keys go back to their documents.  While all second filters
together are at most ``BROADCAST_BITS`` they are broadcast; beyond that, hashes
with their places go to the filters' ranges, and what is held there goes back to
its document for the key.  Ranges that hold a hot line are dealt to several
tasks.  The filters' errors only cost extra shuffling, never a wrong line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, extended, slices, text_hash, texts, without

MIN_DOCS = 10
HASHES = 4
BITS_PER_LINE = 8
RANGES = 1 << 13                                  # of the hash space, while a range's filter has the smaller size
MIN_RANGE_BITS, MAX_RANGE_BITS = 1 << 22, 1 << 28
BROADCAST_BITS = 1 << 29                          # of all second filters: 64 MB
_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line: stripped at both ends, A-Z in lower case."""
    return [x.strip(_STRIP) for x in (text or b"").lower().split(b"\n")]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, by its highest bits (``ranges``: a power of two)."""
    return (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """(hashes, HASHES) bit positions in a range's filter by double hashing."""
    step = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) | np.uint64(1)
    at = h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (at & np.uint64(bits - 1)).astype(np.int64)


def _distinct(keys: list[bytes], min_chars: int) -> list[bytes]:
    """A document's distinct keys of ``min_chars`` code points or more, in order of first place."""
    return [k for k in dict.fromkeys(keys) if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)]


def _held(bloom: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bloom[pos >> 3] >> (pos & 7).astype(np.uint8) & 1).all(axis=1)


def _set(bloom: np.ndarray, pos: np.ndarray) -> None:
    p = pos.ravel()
    np.bitwise_or.at(bloom, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def _hash_batches(ranges: int, min_chars: int):
    """Texts to (range, hash, documents of the slice), a row per hash and slice."""
    def run(batches):
        for b in slices(batches, "_text"):
            got = [_hashes(keys) for t in texts(b.column("_text")) if (keys := _distinct(line_keys(t), min_chars))]
            if got:
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_range(h, ranges).astype(np.int32)), pa.array(h.view(np.int64)),
                                                  pa.array(n.astype(np.int64))], ["range", "hash", "n"])
    return run


def _filter_batches(bits: int):
    """The hashes of a range to its second filter and the number of their rows."""
    def run(batches):
        once = np.zeros(bits // 8, dtype=np.uint8)
        twice = np.zeros(bits // 8, dtype=np.uint8)
        at, rows = None, 0
        for b in batches:
            if b.num_rows:
                at = b.column("range")[0].as_py()
                n = b.column("n").to_numpy()
                rows += int(n.sum())
                h, first, times = np.unique(b.column("hash").to_numpy().view(np.uint64), return_index=True, return_counts=True)
                pos = _positions(h, bits)
                many = np.zeros(len(n), dtype=bool)
                many[first] = times > 1
                _set(twice, pos[(many | (n > 1))[first] | _held(once, pos)])
                more = np.flatnonzero(n > 1)
                _set(twice, _positions(b.column("hash").to_numpy()[more].view(np.uint64), bits))
                _set(once, pos)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([rows]), pa.array([twice.tobytes()])],
                                             ["range", "rows", "twice"])
    return run


def twice_filters(docs: DataFrame, ranges: int, bits: int, min_chars: int) -> DataFrame:
    """A row per range with lines: ``range``, ``rows`` (lines of documents) and
    ``twice``, the packed filter of keys seen twice or more (``bits`` / 8 bytes)."""
    hashes = docs.mapInArrow(_hash_batches(ranges, min_chars), "range int, hash long, n long")
    return checkpointed(hashes.repartitionById(ranges, "range").mapInArrow(_filter_batches(bits), "range int, rows long, twice binary"))


def _suspect_batches(held, ranges: int, bits: int, min_chars: int):
    """Texts to their suspected lines, by the broadcast filters of all ranges."""
    def run(batches):
        twice = np.frombuffer(held.value, np.uint8)
        for b in slices(batches, "_text"):
            row, key, line = [], [], []
            for i, t in enumerate(texts(b.column("_text"))):
                keys = line_keys(t)
                own = _distinct(keys, min_chars)
                if not own:
                    continue
                h = _hashes(own)
                hit = _held(twice, _positions(h, bits) + _range(h, ranges).astype(np.int64)[:, None] * bits)
                if hit.any():
                    first = {}
                    for n, k in enumerate(keys):
                        first.setdefault(k, n)
                    for j in np.flatnonzero(hit).tolist():
                        row.append(i)
                        key.append(own[j])
                        line.append(first[own[j]])
            if row:
                yield _suspects(b, row, key, line)
    return run


def _suspects(b: pa.RecordBatch, row: list, key: list, line: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [b.column("_id").take(pa.array(row)), b.column("_h").take(pa.array(row)),
         pa.array(key, pa.binary()).cast(pa.string()), pa.array(line, pa.int32())], ["_id", "_h", "_key", "_line"])


def _place_batches(ranges: int, start, min_chars: int):
    """Texts to (task, hash, place) of each distinct line; a range's tasks begin at ``start``."""
    def run(batches):
        first_task = np.frombuffer(start.value, np.int64)
        for b in slices(batches, "_text"):
            row, line, got = [], [], []
            for i, t in enumerate(texts(b.column("_text"))):
                first = {}
                for n, k in enumerate(line_keys(t)):
                    first.setdefault(k, n)
                own = _distinct(list(first), min_chars)
                if own:
                    row += [i] * len(own)
                    line += [first[k] for k in own]
                    got.append(_hashes(own))
            if row:
                h, at = np.concatenate(got), pa.array(row)
                dh = b.column("_h").take(at)
                r = _range(h, ranges).astype(np.int64)
                lot = dh.to_numpy().view(np.uint64) % (first_task[r + 1] - first_task[r]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((first_task[r] + lot.astype(np.int64)).astype(np.int32)), pa.nulls(len(h), pa.binary()),
                     pa.array(h.view(np.int64)), b.column("_id").take(at), dh, pa.array(line, pa.int32())],
                    ["task", "twice", "hash", "_id", "_h", "_line"])
    return run


def _held_batches(bits: int):
    """A task's filter, then its hashes, to the places of what the filter holds."""
    def run(batches):
        twice = None
        for b in batches:
            if not b.num_rows:
                continue
            if twice is None:
                twice = np.frombuffer(b.column("twice")[0].as_py(), np.uint8)
                b = b.slice(1)
            hit = _held(twice, _positions(b.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits))
            yield b.filter(pa.array(hit)).select(["_id", "_h", "_line"])
    return run


def _key_batches(batches):
    """Texts with the numbers of suspected lines to their keys."""
    for b in slices(batches, "_text"):
        row, key, line = [], [], []
        for i, (t, at) in enumerate(zip(texts(b.column("_text")), b.column("_lines").to_pylist())):
            keys = line_keys(t)
            for n in at:
                row.append(i)
                key.append(keys[n])
                line.append(n)
        if row:
            yield _suspects(b, row, key, line)


def _suspects_by_range(docs: DataFrame, filters: DataFrame, ranges: int, bits: int, min_chars: int, kind: str) -> DataFrame:
    """The suspected lines where the filters are too large to be broadcast."""
    rows = np.zeros(ranges, dtype=np.int64)
    for r in filters.select("range", "rows").collect():      # a row per range
        rows[r["range"]] = r["rows"]
    tasks = np.maximum(1, -(-rows * BITS_PER_LINE // bits))   # a range with a hot line has several
    start = np.concatenate(([0], np.cumsum(tasks)))
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(start.tobytes())
    places = docs.mapInArrow(_place_batches(ranges, held, min_chars),
                             f"task int, twice binary, hash long, _id {kind}, _h long, _line int")
    lots = F.broadcast(spark.createDataFrame([(i, int(start[i]), int(start[i + 1]) - 1) for i in range(ranges)],
                                             "range int, _from int, _to int"))
    sent = filters.join(lots, "range").select(F.explode(F.sequence("_from", "_to")).alias("task"), "twice")
    sent = sent.select("task", "twice", F.lit(0).cast("long").alias("hash"), F.lit(None).cast(kind).alias("_id"),
                       F.lit(0).cast("long").alias("_h"), F.lit(0).alias("_line"))
    found = (sent.unionByName(places).repartitionById(int(start[-1]), "task").sortWithinPartitions(F.col("twice").isNull())
             .mapInArrow(_held_batches(bits), f"_id {kind}, _h long, _line int"))
    lines = found.groupBy("_id", "_h").agg(F.collect_set("_line").alias("_lines")).withColumnsRenamed({"_id": "_i", "_h": "_ih"})
    # the lines of equal (id, text) rows are the same; each of the rows counts, so each takes them
    back = docs.join(lines, docs["_id"].eqNullSafe(lines["_i"]) & (docs["_h"] == lines["_ih"])).select("_id", "_h", "_text", "_lines")
    return back.mapInArrow(_key_batches, f"_id {kind}, _h long, _key string, _line int")


def _drop_batches(batches):
    for b in slices(batches, "__lm_text"):
        n, lost, kept = [], [], []
        for t, gone in zip(texts(b.column("__lm_text")), b.column("__lm_lines").to_pylist()):
            lines = (t or b"").split(b"\n")
            if gone:
                keys = line_keys(t)
                bad = {keys[i] for i in gone}
                left = [x for x, k in zip(lines, keys) if k not in bad]
            else:
                left = lines
            n.append(len(lines))
            lost.append(len(lines) - len(left))
            kept.append(b"\n".join(left))
        keep = [c for c in b.schema.names if not c.startswith("__lm_")]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(lost, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], [*keep, "n_lines", "n_dropped", "kept_text"])


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                min_chars: int = 1, keep_first: bool = False, bits: int | None = None,
                broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """``df`` without its text, with ``n_lines``, ``n_dropped`` and
    ``kept_text``; input columns named so are replaced.

    Lines are cut at ``\\n`` (a null or empty text is one empty line).  Keys of
    at least ``min_chars`` code points found in ``min_docs`` rows or more lose
    all their lines; with ``keep_first`` the row of the smallest id (then text
    hash) keeps them (first-occurrence choice).  Every row counts as a
    document, repeated rows too.  An empty table gives no rows.  ``bits`` (a power
    of two) is the size of a range's filter; neither it nor ``broadcast_bits`` changes the result.
    """
    min_chars = max(1, min_chars)
    docs = df.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()
    lines = docs.agg(F.sum(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    if bits is None:
        share = int(lines * BITS_PER_LINE // RANGES)
        bits = min(MAX_RANGE_BITS, max(MIN_RANGE_BITS, 1 << share.bit_length()))
    ranges = 1 << max(0, -(-int(lines) * BITS_PER_LINE // bits) - 1).bit_length()
    filters = twice_filters(docs, ranges, bits, min_chars)
    if ranges * bits <= broadcast_bits:
        packed = np.zeros(ranges * bits // 8, dtype=np.uint8)
        for r in filters.collect():
            packed[r["range"] * (bits // 8):][:bits // 8] = np.frombuffer(r["twice"], np.uint8)
        held = df.sparkSession.sparkContext.broadcast(packed.tobytes())
        suspects = docs.mapInArrow(_suspect_batches(held, ranges, bits, min_chars), f"_id {kind}, _h long, _key string, _line int")
    else:
        suspects = _suspects_by_range(docs, filters, ranges, bits, min_chars, kind)
    suspects = checkpointed(suspects)
    seen = suspects.groupBy("_key").agg(F.count(F.lit(1)).alias("n"),
                                        F.min(F.struct(F.col("_id").isNull(), "_id", "_h")).alias("first"))
    repeats = checkpointed(seen.filter(F.col("n") >= min_docs))   # apart from the count, so that a hot key's join can be split
    drops = suspects.join(repeats, "_key")
    if keep_first:
        drops = drops.filter(~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_h") == F.col("first._h"))))
    drops = drops.groupBy("_id", "_h").agg(F.collect_set("_line").alias("__lm_lines")) \
                 .withColumnsRenamed({"_id": "__lm_id", "_h": "__lm_dh"})
    df = without(df, "n_lines", "n_dropped", "kept_text")
    rest = [c for c in df.columns if c != text_col]
    d = df.select(*rest, F.col(text_col).alias("__lm_text"), text_hash(F.col(text_col)).alias("__lm_h"))
    joined = d.join(drops, d[id_col].eqNullSafe(drops["__lm_id"]) & (d["__lm_h"] == drops["__lm_dh"]), "left") \
              .select(*[d[c] for c in rest], "__lm_text", "__lm_lines")
    schema = extended(df.select(*rest).schema, n_lines=T.LongType(), n_dropped=T.LongType(), kept_text=T.StringType())
    return joined.mapInArrow(_drop_batches, schema)
