"""Helpers shared by the operators: Arrow text access, lineage cuts, grouped
iteration over sorted batches, and row-level winners."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

SLICE_BYTES = 8 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder of ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A new path under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "limnos-llm", *parts, uuid.uuid4().hex)


def binary(col: pa.Array) -> pa.Array:
    """A text column as binary (no copy); nulls stay."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())


def texts(col: pa.Array) -> list:
    """UTF-8 bytes of each text, ``None`` for null."""
    return binary(col).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], col: str,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about ``max_bytes`` of text (one
    text at least), which bounds a worker's memory for long documents."""
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = pc.binary_length(binary(b.column(col))).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        if ends[-1] <= max_bytes:
            yield b
            continue
        at, base = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(at, to - at)
            at, base = to, int(ends[to - 1])


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array with n + 1 offsets (null: empty)."""
    arr = binary(col)
    if arr.null_count:
        arr = arr.fill_null(b"")
    wide = pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text: how many of its bytes the mask marks."""
    c = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def word_counts(col: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: 0)."""
    buf, off = flat(col)
    if not len(buf):
        return np.zeros(len(col), dtype=np.int64)
    ws = _WS[buf]
    start = ~ws
    start[1:] &= ws[:-1]
    first = off[:-1][off[1:] > off[:-1]]
    start[first] = ~ws[first]
    return sums(start, off)


def whitespace(buf: np.ndarray) -> np.ndarray:
    return _WS[buf]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Groups of a partition sorted by its (integer) key columns, as numpy
    columns; only one group is held at a time."""
    held: list[dict] = []
    held_key = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        change = np.zeros(b.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(int(cols[k][lo]) for k in keys)
            if held and key != held_key:
                yield held_key, _merged(held)
                held = []
            held_key = key
            held.append({n: v[lo:hi] for n, v in cols.items() if n not in keys})
    if held:
        yield held_key, _merged(held)


def _merged(parts: list[dict]) -> dict:
    if len(parts) == 1:
        return parts[0]
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def first_by_hash(df: DataFrame, order: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of the smallest 64-bit hash ``order``.  A cut of the hash
    range leaves about ``2 n`` rows to sort, however many tasks there are; it
    is widened until it holds enough."""
    total = df.count()
    share = min(1.0, 2 * n / max(1, total))
    while True:
        cut = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
        rows = df.withColumn("__lm_order", order).filter(F.col("__lm_order") <= cut)
        if share >= 1 or rows.count() >= min(n, total):
            return rows.orderBy("__lm_order", *ties).limit(n).drop("__lm_order")
        share = min(1.0, 4 * share)


def text_hash(text: Column) -> Column:
    """64 bits of a text; null has its own value."""
    return F.xxhash64(text.isNull(), text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    """A schema with further columns."""
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add (clashing extras go;
    names compare without case, as Spark resolves them)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])
