"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import empty, frame, odd, odd_rows  # noqa: F401
from limnos.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words):
    """(start, length, period) of all runs, by start, then period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, v in enumerate(same):
            if v and start is None:
                start = i
            elif not v and start is not None:
                if i + q - start >= max(6, 4 * q):
                    best.setdefault((start, i + q), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def looped(rng, n, letters):
    words = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
        for i in range(a, min(n, a + rng.randint(1, 6 * p + 3))):
            words[i] = words[a + (i - a) % p]
    return words


def test_solver_matches_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 300)
        words = looped(rng, n, "abcdefgh"[:rng.choice([1, 2, 3, 8])])
        x = np.array([ord(w) for w in words])
        q, s, e = periodic_runs.solve(x, np.full(n, n // 4), 1, 1 << 12)
        assert sorted(zip(s.tolist(), (e - s).tolist(), q.tolist())) == slow_runs(words)


def test_strings_whose_hashes_agree():
    a = [0]
    for _ in range(12):                     # Thue-Morse: stretches and their complements share 64-bit polynomial hashes
        a += [1 - v for v in a]
    for words in (a, a[:2000] + [5] * 30 + a[:2000] * 2):
        x = np.array(words)
        q, s, e = periodic_runs.solve(x, np.full(len(x), 60), 1, 64)
        want = [r for r in slow_runs(words[:600]) if r[0] + r[1] < 600 and r[2] <= 60]
        assert sorted(r for r in zip(s.tolist(), (e - s).tolist(), q.tolist()) if r[0] + r[1] < 600) == want


def test_a_long_text_of_one_word_is_linear():
    x = np.zeros(300_000, dtype=np.int64)
    q, s, e = periodic_runs.solve(x, np.full(len(x), len(x) // 4), 1, 1 << 17)
    assert (q.tolist(), s.tolist(), e.tolist()) == ([1], [0], [300_000])


def check(rows, got):
    want = Counter()
    for i, text in rows:
        words = WORD.findall(text or "")
        runs = slow_runs(words)
        want[i, len(words), tuple(runs), collapsed(words, runs)] += 1
    have = Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed_text"])
                   for r in got)
    assert have == want
    assert all(r["collapsed_sha256"] == sha(r["collapsed_text"]) for r in got)


def awkward():
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 20000]
    rows += [(100 + i, " ".join(looped(rng, rng.randint(1, 250), "abcdefgh"[:rng.choice([1, 2, 8])]))) for i in range(40)]
    return rows + [(200, "x " * 6), (201, "x " * 5), (202, "a b " * 4), (203, "a b a b a b a"), (204, "\u00e9\x1c \u00e9\x1c\n" * 9), (200, "x " * 6)]


@pytest.mark.parametrize("tile", [None, (4, 2, 2), (16, 4, 1)])
def test_documents_match_brute_force(spark, monkeypatch, tile):
    if tile:                                # several tiles and bands a document, stitched
        for name, v in zip(("TILE_PERIODS", "BAND", "STRIDE"), tile):
            monkeypatch.setattr(periodic_runs, name, v)
        monkeypatch.setattr(periodic_runs, "BLOCK", 64)
    rows = awkward()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(rows, periodic_runs.find_runs(df, keep_text=True).collect())


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = WORD.findall(d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 4000:
            continue                        # too slow by brute force
        runs = slow_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        assert got[d["doc_id"]] == (d["doc_id"], len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                                    sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(collapsed(words, runs)))
    assert planted > 5 and sum(r[1] > 0 for r in got.values()) > 5


def test_empty_table_and_clashing_columns(spark, empty):
    assert periodic_runs.find_runs(empty, keep_text=True).count() == 0
    df = frame(spark, [(i, "a b " * 9, None, None, 1) for i in (1, 1, None)])
    for name in ("_id", "key", "runs", "words", "kind", "period", "of", "collapsed_text"):
        df = df.withColumn(name, F.lit("x"))
    out = periodic_runs.find_runs(df)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed_sha256"]
    assert [[tuple(x) for x in r["runs"]] for r in out.collect()] == [[(0, 18, 2)]] * 3
