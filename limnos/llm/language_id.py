"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one pass that counts hashed n-grams (orders 1 to 3) per language,
pre-aggregated in each partition; the log-probability matrix (``BUCKETS`` x
languages, a fixed bound per language) is broadcast.  Scoring is a sparse batch
product in numpy: the texts of a slice are one sparse matrix of bucket counts
(rows of distinct buckets), multiplied with the log-probabilities in blocks of
``PRODUCT`` terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTH = 0.5
MAX_LANGS = 2000       # most languages a model may have: bounds the broadcast matrix
PRODUCT = 1 << 21      # terms of the product held at once
UNDETERMINED = "und"
_MIX = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(chars: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of a code point array (uint32)."""
    out = []
    h = np.zeros(len(chars), dtype=np.uint32)
    for n in ORDERS:
        m = len(chars) - n + 1
        if m < 1:
            break
        h = (h[:m] ^ chars[n - 1:n - 1 + m]) * _MIX
        h ^= h >> np.uint32(15)
        out.append(((h + np.uint32(n)) * _MIX >> np.uint32(17)) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _count_batches(batches):
    """Per partition: n-gram counts of each language, as (lang, counts)."""
    held: dict[str, np.ndarray] = {}
    for b in slices(batches, "_text"):
        for t, lang in zip(b.column("_text").to_pylist(), b.column("_lang").to_pylist()):
            if lang not in held:
                held[lang] = np.zeros(BUCKETS, dtype=np.int64)
            if t:
                g = grams(code_points(t))
                if len(g) > BUCKETS // 8:
                    held[lang] += np.bincount(g, minlength=BUCKETS)
                else:
                    np.add.at(held[lang], g, 1)
    for lang, n in held.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                         ["lang", "bucket", "n"])


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of shape BUCKETS x languages) from the
    rows with text and language; prior-free, as texts outweigh priors."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
             .select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    counts = rows.mapInArrow(_count_batches, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")) \
                   .limit(MAX_LANGS + 1).collect()
    if len(packed) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages: is {lang_col} a language code?")
    packed.sort(key=lambda r: r["lang"])
    logs = np.zeros((BUCKETS, len(packed)), dtype=np.float32)
    for j, r in enumerate(packed):
        n = np.full(BUCKETS, SMOOTH)
        n[np.array(r["b"], dtype=np.int64)] += np.array(r["n"], dtype=np.float64)
        logs[:, j] = np.log(n / n.sum())
    return [r["lang"] for r in packed], logs


def bucket_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse count matrix of texts: (row offsets, buckets, counts); rows of
    texts without a letter are empty."""
    off, at, n = [0], [], []
    for t in texts:
        if has_letter(t):
            g = grams(code_points(t))
            if len(g) > BUCKETS // 8:
                whole = np.bincount(g, minlength=BUCKETS)
                own = np.flatnonzero(whole)
                times = whole[own]
            else:
                own, times = np.unique(g, return_counts=True)
            at.append(own.astype(np.int64))
            n.append(times.astype(np.float64))
            off.append(off[-1] + len(own))
        else:
            off.append(off[-1])
    return np.array(off), np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(n or [np.zeros(0)])


def sparse_product(off: np.ndarray, at: np.ndarray, n: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Rows x languages: counts times log-probabilities, some rows and languages at a time."""
    out = np.zeros((len(off) - 1, logs.shape[1]))
    rows = np.flatnonzero(np.diff(off))
    wide = max(1, min(logs.shape[1], PRODUCT // BUCKETS))        # a row holds BUCKETS entries at most
    for lo in range(0, logs.shape[1], wide):
        part = logs[:, lo:lo + wide]
        k = 0
        while k < len(rows):
            to = max(k + 1, int(np.searchsorted(off[rows + 1], off[rows[k]] + PRODUCT // part.shape[1], side="right")))
            first, last = off[rows[k]], off[rows[to - 1] + 1]
            out[rows[k:to], lo:lo + wide] = np.add.reduceat(n[first:last, None] * part[at[first:last]], off[rows[k:to]] - first, axis=0)
            k = to
    return out


def predict_batch(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(languages, posterior probabilities) of texts; undetermined without a letter."""
    if not langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    off, at, n = bucket_counts(texts)
    total = sparse_product(off, at, n, logs)
    best = total.argmax(axis=1)
    score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    known = np.diff(off) > 0
    return [langs[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0)


def predict(text: str | None, langs: list[str], logs: np.ndarray) -> tuple[str, float]:
    """(language, posterior probability) of one text."""
    lang, score = predict_batch([text], langs, logs)
    return lang[0], float(score[0])


def _predict_batches(langs: list[str], held):
    def run(batches):
        logs = held.value
        for b in slices(batches, "_text"):
            lang, score = predict_batch(b.column("_text").to_pylist(), langs, logs)
            keep = [c for c in b.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             [*keep, "lang_pred", "score"])
    return run


def held_out(id_col: Column) -> Column:
    """The rows kept out of training: crc32 of the id as text has remainder 1 by 3
    (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``df``: id, ``held_out``, ``lang_pred``, ``score``.

    Learns from rows that are not held out and have text and language; the
    prediction reads the text only.  Null texts and texts without a letter
    get ``und`` with score 0, as does everything when nothing can be learnt.
    Equal scores go to the smaller language code.  Null ids and repeated rows
    are rows like others; other columns are not read.
    """
    langs, logs = train(df.filter(~held_out(F.col(id_col))), text_col, lang_col)
    held = df.sparkSession.sparkContext.broadcast(logs)
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text")) \
            .mapInArrow(_predict_batches(langs, held), f"_id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("_id", id_col)
