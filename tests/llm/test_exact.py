"""Operators against brute-force versions written from their contracts."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_rows import empty, frame, no_labels, odd, odd_rows  # noqa: F401
from limnos.llm import decontaminate, licenses, line_dedup, mixing, queries, quality_rules, secret_scan, sharding, simhash

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def both(spark, odd):
    return ((spark.read.parquet(f"{SF}/documents.parquet"), docs(spark)), (odd, [r.asDict() for r in odd.collect()]))


def by_id(rows, key="doc_id"):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


# ------------------------------------------------------------------ sharding

def test_sharding_places_every_row_once(spark, odd):
    for df, rows in both(spark, odd):
        got = sharding.shuffle_to_shards(df, 16, bucket_bytes=4096).collect()
        assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in got])) == sorted(repr((r["doc_id"], r["text"])) for r in rows)
        for s, own in by_id(got, "shard").items():
            assert sorted(r["slot"] for r in own) == list(range(len(own))) and 0 <= s < 16
        assert all(len({r["shard"] for r in own}) == 1 for own in by_id(got).values())


def test_sharding_is_seeded_independent_of_layout_and_shuffled(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    run = lambda d, **k: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_to_shards(d, 4, **k).collect()}
    a = run(df)
    assert a == run(df.repartition(7)) and a != run(df, seed=1)
    order = [i for i, (s, _) in sorted(a.items(), key=lambda x: x[1]) if s == 0]
    assert order != sorted(order) and abs(len(order) - 750) < 150


def test_grown_shards_take_rows_only_into_the_new_one(spark):
    rows = spark.range(4000).select(sharding.shard_of(F.col("id"), 16).alias("a"), sharding.shard_of(F.col("id"), 17).alias("b")).collect()
    assert all(r["b"] in (r["a"], 16) for r in rows) and any(r["b"] == 16 for r in rows)


def test_fisher_yates_permutes():
    assert sorted(sharding.fisher_yates(500, [1, 2, 3]).tolist()) == list(range(500))
    assert sharding.fisher_yates(0, [1]).tolist() == []


def test_op1_digests(spark):
    got = queries.op1_sharding(spark, SF).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs(spark)}
    assert {r["doc_id"] for r in got} == set(text) and len(got) == len(text)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)
    for own in by_id(got, "shard").values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_written_shards_are_in_slot_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(9).alias("Shard"))
    sharding.write_shards(sharding.shuffle_to_shards(df, 2, bucket_bytes=300), str(tmp_path / "out"))
    for part in (tmp_path / "out" / "shard=0").glob("*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(part)).collect()]
        assert slots == sorted(slots)


# ------------------------------------------------------------------ SimHash

def slow_fingerprint(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(fps, bits=4):
    """fps: list of (id, fingerprint); smallest id (nulls last) of each."""
    u = sorted({f for _, f in fps})
    root = {f: f for f in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(u, dtype=np.uint64)
    for i, x in enumerate(u):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits).tolist():
            root[find(x)] = find(u[j])
    low = {}
    for i, f in fps:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return [(i, f"{f:016x}", low.get(find(f))) for i, f in fps]


@pytest.mark.parametrize("parts", [1, 2])
def test_simhash_matches_brute_force(spark, odd, parts):
    for df, rows in both(spark, odd):
        want = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in rows])
        got = [tuple(r) for r in simhash.near_duplicates(df, parts=parts).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_anchors_cover_every_pair_within_four_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    for parts in (1, 2):
        row, key, home = simhash.anchor_rows(x, parts)
        homes = {(r, k) for r, k, h in zip(row.tolist(), key.tolist(), home.tolist()) if h}
        row, key, _ = simhash.anchor_rows(y, parts)
        reached = {r for r, k in zip(row.tolist(), key.tolist()) if (r, k) in homes}
        assert reached == set(range(300))


def test_components_of_a_chain_and_a_crowd(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
                    ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)))
    monkeypatch.setattr(simhash, "TILE", 50)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "_fp long")
    links = simhash.fingerprint_links(df, 4, 1)
    assert links.count() < 60 * len(fps)
    assert len({r["root"] for r in simhash.components(links).collect()}) == 1


def test_one_per_group_keeps_whole_rows(spark, odd):
    rows = [r.asDict() for r in odd.collect()]
    want = slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in rows])
    kept = simhash.one_per_group(odd.withColumn("_fp", F.lit("x")).withColumn("component_id", F.lit(1)))
    assert kept.columns == [*odd.columns, "_fp", "component_id"]
    assert kept.count() == len({c if c is not None else f for _, f, c in want})
    ids = {r["doc_id"] for r in kept.collect()}
    assert {c for _, _, c in want if c is not None} <= ids


# ------------------------------------------------------------------ rule statistics

def slow_stats(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": dup, "n_repeat_words": len(cover),
            "base_failed": len(w) < 20 or 100 * len(cover) > 30 * len(w)}


def test_rule_statistics_match_brute_force(spark, odd):
    for df, rows in both(spark, odd):
        got = [r.asDict() for r in quality_rules.rule_statistics(df).collect()]
        pick = lambda r: tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        want = Counter((r["doc_id"], *pick(slow_stats(r["text"]))) for r in rows)
        assert Counter((r["_id"], *pick(r)) for r in got) == want


def test_repeated_windows_and_lines():
    w = [b"a"] * 9
    assert quality_rules.repeat_words(w) == 9 and quality_rules.repeat_words(w[:8]) == 0
    ten = [b"%d" % i for i in range(8)]
    assert quality_rules.repeat_words(ten + [b"x"] + ten) == 16
    assert quality_rules.dup_lines(b"a\n\na\n \n \nb\na") == 2


# ------------------------------------------------------------------ licences

def slow_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    out = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), out


def test_license_base_matches_brute_force(spark, odd):
    extra = ["Under the MIT license under-the/mit.license!", "CC BY-NC cc by nc by nc", "apache License, version 2.0 é apache license version 2",
             "under the mit under the mit license", licenses.NOTICES[1][1].upper(), "cc by", "the mit license"]
    more = frame(spark, [(900 + i, t, None, None, None) for i, t in enumerate(extra)]).union(odd)
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), docs(spark)), (more, [r.asDict() for r in more.collect()])):
        got = by_id([r.asDict() for r in licenses.scan_licenses(df).collect()])
        assert sum(map(len, got.values())) == len(rows)
        for r in rows:
            n, places = slow_places(r["text"])
            starts = [i for i, _ in places]
            want = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
            assert want in [(g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) for g in got[r["doc_id"]]]
            for g in got[r["doc_id"]]:
                assert set(g["base_labels"].split(",")) - {""} <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1


def test_automaton_matching_statistics():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(12)]
    auto = licenses.Automaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = rng.integers(0, 4, 400).tolist()
    state = n = 0
    for j, c in enumerate(text):
        state, n = auto.step(state, n, c)
        best = max((k for k in range(0, j + 2) if k == 0 or tuple(text[j + 1 - k:j + 1]) in subs))
        assert n == best
        if n:
            ends = {(t, e) for t, s in enumerate(seqs) for e in range(n, len(s) + 1) if s[e - n:e] == text[j + 1 - n:j + 1]}
            assert set(auto.ends[state]) == ends


def test_notices_are_chained_over_gaps():
    scanner = licenses.Scanner()
    notice = licenses.NOTICES[2][1].split()
    text = "intro " + " ".join(notice[:9]) + " * 1 * " + " ".join(notice[9:]) + " rest"
    row = scanner.row(text.encode())
    assert row[5] == "bsd" and row[6] == 1.0 and json.loads(row[7])[0][:3] == [1, 1 + len(notice) + 1, "bsd"]
    assert scanner.row(" ".join(notice[:6]).encode())[5] == ""
    assert scanner.row(" ".join(reversed(notice)).encode())[5] == ""


def test_every_place_of_a_notice_is_a_span():
    scanner = licenses.Scanner()
    mit, bsd = (licenses.NOTICES[k][1].split() for k in (0, 2))
    spans = lambda w: json.loads(scanner.row(" ".join(w).encode())[7])
    n, b = len(mit), len(bsd)
    for gap in (0, 3, 40):
        own = ["other"] * gap
        assert spans((mit + own) * 50) == [[i * (n + gap), i * (n + gap) + n, "mit", 1.0] for i in range(50)]
        part = mit[:20] + ["changed"] + mit[22:]           # a lesser copy, before and after a whole one
        got = spans(part + own + mit + own + bsd + own + part)
        assert [x[2] for x in got] == ["mit", "mit", "bsd", "mit"]
        at = n - 1 + gap
        assert [x[:2] for x in got] == [[0, n - 1], [at, at + n], [at + n + gap, at + n + gap + b], [at + n + b + 2 * gap, at + 2 * n + b + 2 * gap - 1]]
        assert all(x[3] >= 0.7 for x in got)
    assert len(spans(mit[:n // 2] + ["other"] * 40 + mit[:n // 2])) == 0


# ------------------------------------------------------------------ lines

def slow_lines(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = [(r["text"] or "").split("\n") for r in rows]
    n = Counter(k for x in split for k in {key(y) for y in x} if k)
    out = []
    for r, x in zip(rows, split):
        left = [y for y in x if n[key(y)] < least]
        out.append((r["doc_id"], len(x), len(x) - len(left), "\n".join(left)))
    return out


@pytest.mark.parametrize("bits", [None, 64])
def test_line_dedup_matches_brute_force(spark, odd, bits):
    boiler = [(1000 + i, f"own {i}\n  Shared LINE \t\nÀ propos\n\nshared line\n{'twelve' if i < 9 else 'x' * i}", None, None, None) for i in range(14)]
    more = frame(spark, boiler).union(odd)
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), docs(spark)), (more, [r.asDict() for r in more.collect()])):
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(df, bits=bits and 1 << 10).collect()]
        assert Counter(got) == Counter(slow_lines(rows))


@pytest.mark.parametrize("bits", [None, 1 << 10])
def test_line_dedup_by_range_gives_the_same(spark, odd, bits):
    """Filters too large to be broadcast: hashes with their places go to the ranges instead."""
    for df in (odd, odd.unionByName(odd)):
        for first in (False, True):
            small, large = (sorted(map(str, line_dedup.dedup_lines(df, bits=bits, min_docs=2, keep_first=first, broadcast_bits=b).collect()))
                            for b in (1 << 29, 0))
            assert small == large and len(small) == df.count()


def test_line_dedup_lets_few_unique_lines_through(spark):
    """2^20 lines in filters of 2^18 bits (32 ranges): the share of unique lines that shuffle is that of one filter."""
    n, lines = 1 << 12, 1 << 8
    docs = spark.range(n).select(F.col("id").alias("_id"), F.lit(0).cast("long").alias("_h"), F.concat_ws(
        "\n", F.lit("the same"), F.transform(F.sequence(F.lit(2), F.lit(lines)), lambda i: F.concat(F.col("id"), F.lit(":"), i.cast("string")))).alias("_text"))
    bits, ranges = 1 << 18, 32
    filters = line_dedup.twice_filters(docs, ranges, bits, 1)
    assert filters.count() == ranges and filters.agg(F.sum("rows")).first()[0] == n * lines
    found = line_dedup._suspects_by_range(docs, filters, ranges, bits, 1, "bigint").groupBy((F.col("_key") == "the same").alias("k")).count()
    got = {r["k"]: r["count"] for r in found.collect()}
    assert got[True] == n and got.get(False, 0) < 0.01 * n * lines


def test_line_dedup_first_occurrence(spark):
    df = frame(spark, [(i, "head\nbody %d" % i, None, None, None) for i in range(12)])
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(df, keep_first=True).collect()}
    assert got[0] == "head\nbody 0" and all(got[i] == f"body {i}" for i in range(1, 12))


# ------------------------------------------------------------------ secrets

def slow_spans(text):
    out = []
    a = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, (kind, p, ok) in enumerate((("assign", a, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
                                       ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in p.finditer(text or "") if ok(m)]
    return [s for *_, s in sorted(out)]


def test_secret_base_spans_match_brute_force(spark, odd):
    extra = ["passwd=token:abcdefgh PASSWORD = 'hunter22'", "é api_key: \"" + "0123456789abcdef" * 2 + "\"", "AKIA" + "A1" * 8 + " AKIAAKIAAKIAAKIA",
             "toKen=abcdefgh ſecret=abcdefgh", "secret=secret=abc", "x" * 30 + " ghp_" + "a1B2" * 9, "AKIAAKIA" + "Z" * 20]
    more = frame(spark, [(900 + i, t, None, "s", None) for i, t in enumerate(extra)]).union(odd)
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), docs(spark)), (more, [r.asDict() for r in more.collect()])):
        got = [r.asDict() for r in secret_scan.scan_secrets(df).collect()]
        want = Counter((r["doc_id"], ",".join(slow_spans(r["text"]))) for r in rows)
        assert Counter((g["doc_id"], g["base"]) for g in got) == want
        for g in got:
            base = g["base"].split(",") if g["base"] else []
            assert set(base) <= set(g["spans"].split(","))
            assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(s.startswith(k + ":") for s in base) for k in ("assign", "access", "hex"))


def test_ownership_separates_examples_from_live(spark):
    live, example = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF", "ghp_" + "1111aaaaBBBB2222ccccDDDD3333eeee"
    rows = [(i, f"see {example}", "en", f"owner{i}", None) for i in range(6)] + [(9, f"mine {live}", "en", "owner1", None)]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(frame(spark, rows)).collect()}
    assert got[9]["spans"].startswith("prefixed:5:") and got[9]["n_live"] == 1
    assert all(got[i]["spans"] == "" and got[i]["n_example"] == 1 for i in range(6))


def test_repositories_decide_between_owners(spark):
    """Both values have three owners; the one that all but one repository each
    of the strangers keep is that owner's, the other is an example."""
    own, copied = "ghp_" + "a1B2" * 9, "ghp_" + "Z9y8" * 9
    rows = [(i, f"x {own} y", "en", "a" if i < 20 else f"o{i}", 1) for i in range(22)]
    rows += [(100 + i, f"x {copied} y", "en", f"s{i % 3}", 1) for i in range(22)]
    rows += [(200 + i, f"x {copied[::-1]} y ghp_{'q1W2' * 9}", "en", f"t{i % 3}", 1) for i in range(3)]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(frame(spark, rows)).collect()}
    assert all(got[i]["spans"] == "prefixed:2:42" and got[i]["n_live"] == 1 for i in range(22))
    assert all(got[100 + i]["spans"] == "" and got[100 + i]["n_example"] == 1 for i in range(22))
    # one repository of each owner holds every copy: as many effective owners as owners
    flat = [(i, f"x {own} y", "en", "a" if i < 20 else f"o{i}", 7 if i < 20 else i) for i in range(22)]
    assert {r["spans"] for r in secret_scan.scan_secrets(frame(spark, flat), repo_col="n_chars").collect()} == {""}


def test_many_candidates_of_a_long_text_are_linear():
    import random
    import time
    rng = random.Random(1)
    letters = "ABCDEFabcdefghijkl0123456789"
    text = " ".join("".join(rng.choices(letters, k=30)) for _ in range(60_000))
    start = time.process_time()
    base = secret_scan.base_spans(text)
    got = secret_scan.wider_spans(text, base)
    assert len(got) > 30_000 and time.process_time() - start < 20
    small = text[:6000] + " token=abcdefgh " + "ghp_" + "a1B2" * 9 + " key=" + text[:300]
    base, taken, want = secret_scan.base_spans(small), [], []
    taken = [(s, e) for s, e, *_ in base]
    for kind, pattern in secret_scan.WIDER:
        for m in pattern.finditer(small):
            v = m[0]
            bad = kind == "random" and not (any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v)
                                            and secret_scan.entropy(v) >= secret_scan.MIN_ENTROPY)
            if not bad and not any(m.start() < b and a < m.end() for a, b in taken):
                taken.append(m.span())
                want.append((*m.span(), kind, v))
    assert secret_scan.wider_spans(small, base) == sorted(want) and len(want) > 50


def test_secrets_of_one_owner_stay_live_in_many_documents(spark):
    live, example = "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF", "ghp_" + "1111aaaaBBBB2222ccccDDDD3333eeee"
    rows = [(i, f"mine {live} in {i}", "en", "owner1", None) for i in range(20)] + [(50 + i, f"see {example}", "en", f"owner{i}", None) for i in range(3)]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(frame(spark, rows)).collect()}
    assert all(got[i]["spans"] == f"prefixed:5:{5 + len(live)}" and (got[i]["n_live"], got[i]["n_example"]) == (1, 0) for i in range(20))
    assert all(got[50 + i]["spans"] == "" and got[50 + i]["n_example"] == 1 for i in range(3))


# ------------------------------------------------------------------ decontamination

def slow_leaks(text, items):
    w = decontaminate.words(text)
    out = set()
    for i, t in items:
        parts = decontaminate.question_answer(t)
        if not any(parts):
            continue
        ok = True
        for part in parts:
            want = decontaminate.shingles(part)
            k = min(5, len(part))
            have = set(zip(*[w[j:] for j in range(k)]))
            ok &= len(want & have) / len(want) >= 0.8
        if ok:
            out.add(i)
    return out


def test_leaks_match_brute_force(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.read.parquet(f"{SF}/documents.parquet"), bench).collect()}
    want = {(r["doc_id"], i) for r in docs(spark) for i in slow_leaks(r["text"], items)}
    assert got == want and got
    few = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.read.parquet(f"{SF}/documents.parquet"), bench, piece_words=300).collect()}
    assert few == want


def test_leaks_need_question_and_answer(spark, odd, empty):
    q, a = "what is the tall red tower of the old town called by locals", "they call it the lantern of seven bells"
    bench = spark.createDataFrame([(1, f"{q}? {a}"), (2, None), (3, ""), (4, "one")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(200))
    rows = [(1, f"{filler} {q.upper()}! -- {a} {filler}", None, None, None), (2, f"{q} {filler}", None, None, None), (3, a, None, None, None),
            (4, "One, two", None, None, None), (None, f"{q} {a}", None, None, None)]
    df = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {(1, 1), (4, 4), (None, 1)}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()} == {2, 3}
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.drop_leaks(odd, bench.limit(0)).count() == odd.count()


def test_leaks_with_one_word_edited_are_found(spark):
    rng = np.random.default_rng(8)
    filler = " ".join(f"w{i}" for i in range(150))
    items, rows = [], []
    for i, n in enumerate((29, 30, 40, 59)):      # one edit breaks 5 of 25 shingles at least
        w = [f"t{x}" for x in rng.permutation(300)[:n]]
        items.append((i, " ".join(w)))
        for at in (0, n // 4, n // 2, n - 1):
            rows.append((100 * i + at, f"{filler} {' '.join([*w[:at], 'edited', *w[at + 1:]])} {filler}", None, None, None))
        gone = [x if j % 10 else "edited" for j, x in enumerate(w)]
        rows.append((100 * i + 99, f"{filler} {' '.join(gone)} {filler}", None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}
    assert got == {(r[0], r[0] // 100) for r in rows if r[0] % 100 < 99}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(frame(spark, rows), bench).collect()} == {99, 199, 299, 399}


def test_no_covered_passage_scores_under_the_derived_threshold():
    common = [f"c{i}".encode() for i in range(48)]
    rare = [f"r{i}".encode() for i in range(11)]
    items = [(0, rare + common), *((i, common) for i in range(1, 2000))]     # the first item's edge holds its weight
    index = decontaminate.Index(items)
    assert [m[0] for m in index.matches(b" ".join(common).decode(), index.least_score(0.8), 0.8) if index.items[m[0]][0] == 0]
    rng = np.random.default_rng(6)
    items = [(i, [b"t%d" % j for j in rng.zipf(1.3, n) % 50]) for i, n in enumerate(rng.integers(1, 40, 60))]
    index = decontaminate.Index(items)
    least = index.least_score(0.8)
    for _ in range(300):
        w = list(items[rng.integers(0, 60)][1])
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, len(w))] = b"edited"
        w = w[rng.integers(0, 1 + len(w) // 6):]
        text = b" ".join(w).decode()
        assert [m[0] for m in index.matches(text, least, 0.8)] == [m[0] for m in index.matches(text, 1e-6, 0.8)]


def test_wand_finds_all_above_threshold():
    rng = np.random.default_rng(5)
    vocab = [f"t{i}".encode() for i in range(60)]
    items = [(i, [vocab[j] for j in rng.integers(0, 60, 9)], [vocab[j] for j in rng.integers(0, 60, 6)]) for i in range(150)]
    index = decontaminate.Index(items, block=4)
    for _ in range(60):
        terms = sorted({index.vocab[vocab[j]] for j in rng.integers(0, 60, 25) if vocab[j] in index.vocab})
        score = defaultdict(float)
        for t in terms:
            for i, x in index.postings[t]:
                score[i] += x
        for least in (0.3, 0.5, 0.7):
            got = index.search(terms, least)
            assert {i for i, _ in got} == {i for i, x in score.items() if x >= least - 1e-9}
            assert all(math.isclose(x, score[i]) for i, x in got)


# ------------------------------------------------------------------ mixing

def slow_targets(sizes, weights, cap=3):
    out = {i: None for i in range(len(sizes))}
    while True:
        free = [i for i, t in out.items() if t is None]
        left = sum(sizes) - sum(t for t in out.values() if t is not None)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            return [share.get(i, out[i]) for i in range(len(sizes))]
        out.update({i: cap * sizes[i] for i in over})


def test_sainte_lague_is_the_highest_quotient_method():
    rng = np.random.default_rng(2)
    for _ in range(60):
        shares = [float(x) for x in rng.integers(0, 40, rng.integers(1, 8))]
        seats = int(rng.integers(0, 50))
        want = [0] * len(shares)
        if sum(shares):
            for _ in range(seats):
                i = max((i for i, s in enumerate(shares) if s), key=lambda i: (shares[i] / (2 * want[i] + 1), -i))
                want[i] += 1
        assert mixing.sainte_lague(shares, seats) == want


def test_mix_meets_targets(spark, odd):
    for df, rows in both(spark, odd):
        size = lambda r: len(WORD.findall(r["text"] or ""))
        sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
        sizes = [sum(size(r) for r in rows if r["source"] == s) for s in sources]
        goal = dict(zip(sources, slow_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])))
        got = mixing.mix_sources(df).collect()
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], size(r)) for r in rows)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        for s, own in by_id(got, "source").items():
            assert math.isclose(own[0]["target"], goal[s], abs_tol=1e-6) and own[0]["source_size"] == sizes[sources.index(s)]
            assert abs(sum(r["taken"] for r in own) - goal[s]) <= 0.02 * goal[s] + 3
        again = mixing.mix_sources(df.repartition(5)).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixed_documents_hold_what_is_taken(spark, odd):
    plan = Counter()
    for r in mixing.mix_sources(odd).collect():
        plan[r["source"]] += r["taken"]
    copies = mixing.mixed_documents(odd.withColumn("size", F.lit("x")).withColumn("target", F.lit(0)))
    assert copies.columns == [*odd.columns, "size", "target"]
    got = Counter()
    for r in copies.collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == +plan


def test_a_tiny_source_does_not_cut_the_others(spark):
    text = lambda i, n: " ".join(f"d{i}w{j}" for j in range(n))
    rows = [(i, text(i, 150 + i % 80), "en", "big" if i % 3 else "hot", 1) for i in range(900)]
    tiny = [(1000 + i, text(1000 + i, 50), "en", "tiny", 1) for i in range(2)]
    for own in (rows, rows + tiny):
        whole = {r[0]: r[1] for r in own}
        cut, words = Counter(), Counter()
        for r in mixing.mixed_documents(frame(spark, own)).collect():
            assert whole[r["doc_id"]].startswith(r["text"])     # first words of a document, never scraps
            cut[r["source"]] += r["text"] != whole[r["doc_id"]]
            words[r["source"]] += len(r["text"].split())
        assert max(cut.values()) <= 1 and sum(cut.values()) <= len(words)
        goal = {r["source"]: r["target"] for r in mixing.mix_sources(frame(spark, own)).collect()}
        assert all(abs(words[s] - g) <= g / 512 + 1 for s, g in goal.items())


def test_shard_quotas_add_up():
    block, plan = mixing.plan_mix(["a", "b", "c"], [5_000_000, 2_000_000, 90_000])
    whole = round(sum(p["target"] for p in plan) / block)
    assert all(min(p["quotas"]) >= 0 and sum(p["quotas"]) == p["upto"][-1] for p in plan)
    assert sum(sum(p["quotas"]) for p in plan) == whole
    assert [sum(p["quotas"][s] for p in plan) for s in range(16)] == [whole * (s + 1) // 16 - whole * s // 16 for s in range(16)]
    want = [0, 0, 0]                            # highest quotients, one block at a time
    for _ in range(whole):
        want[max(range(3), key=lambda i: (plan[i]["target"] / (2 * want[i] + 1), -i))] += 1
    assert want == [p["upto"][-1] for p in plan]
    # a block is as large whatever other sources there are
    assert mixing.plan_mix(["a", "t"], [5_000_000, 40])[0] == block


def test_shards_hold_their_quotas(spark):
    text = lambda i, n: " ".join(f"d{i}w{j}" for j in range(n))
    sizes = {"hot": [60 + i % 90 for i in range(900)], "mid": [40 + i % 50 for i in range(300)], "low": [30 + i % 20 for i in range(150)],
             "tiny": [25, 30]}
    rows = [(1000 * k + i, text(1000 * k + i, n), "en", src, 1) for k, (src, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    df = frame(spark, rows).withColumn("Shard", F.lit("x"))
    block, plan = mixing.plan_mix(sorted(sizes), [sum(sizes[s]) for s in sorted(sizes)], n_shards=4)
    got, copies = Counter(), Counter()
    out = mixing.mixed_documents(df, n_shards=4, shard_col="shard")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    for r in out.collect():
        got[r["source"], r["shard"]] += len(r["text"].split())
        copies[r["doc_id"], r["shard"]] += 1
    for p in plan:
        quota = [q * block for q in p["quotas"]]
        total = sum(got[p["source"], s] for s in range(4))
        assert abs(total - p["target"]) <= p["target"] * mixing.SLACK + 1
        if not sum(quota):                      # less than half a block: one shard holds the source
            assert got[p["source"], p["spare"]] == total
            continue
        last = max(s for s in range(4) if p["quotas"][s])
        for s in range(4):                      # whole documents, and words left over in the last block
            spare = abs(total - sum(quota)) if s == last else 0
            assert abs(got[p["source"], s] - quota[s]) <= max(sizes[p["source"]]) + spare
    dealt = {r["doc_id"]: r["shards"] for r in mixing.mix_sources(df, n_shards=4).collect()}
    assert +copies == Counter((i, s) for i, own in dealt.items() for s in map(int, own.split(",") if own else []))


# ------------------------------------------------------------------ all operators on odd tables

def test_empty_tables_give_empty_results(spark, empty, no_labels):
    from limnos.llm import language_id, quality_classifier
    for df in (simhash.near_duplicates(empty), simhash.one_per_group(empty), sharding.shuffle_to_shards(empty, 4),
               quality_rules.isolation_rules(empty, no_labels), quality_rules.keep_good(empty, no_labels), licenses.scan_licenses(empty),
               line_dedup.dedup_lines(empty), quality_classifier.classify_quality(empty, no_labels), language_id.identify_languages(empty),
               secret_scan.scan_secrets(empty), mixing.mix_sources(empty), mixing.mixed_documents(empty)):
        assert df.count() == 0


def test_clashing_extra_columns(spark, odd, no_labels):
    from limnos.llm import language_id, quality_classifier
    names = ("size", "shard", "slot", "text_hash", "kept", "score", "lang_pred", "label", "item_id", "_id", "_text", "_h", "n_lines",
             "fingerprint", "target", "taken", "key", "value", "n", "z", "s", "found", "spans", "base", "count", "bucket")
    df = odd.select("*", *[F.lit("x").alias(n) for n in names])
    n = len(odd_rows())
    for out in (simhash.near_duplicates(df), sharding.shuffle_to_shards(df, 4), quality_rules.isolation_rules(df, no_labels),
                licenses.scan_licenses(df), line_dedup.dedup_lines(df), quality_classifier.classify_quality(df, no_labels),
                language_id.identify_languages(df), secret_scan.scan_secrets(df), mixing.mix_sources(df)):
        assert out.count() == n
    for out in (quality_rules.keep_good(df, no_labels), simhash.one_per_group(df), mixing.mixed_documents(df)):
        assert out.columns == df.columns and out.count() > 0


def test_sha_of_kept_lines(spark):
    got = {r["doc_id"]: r["kept_sha256"] for r in queries.op5_line_dedup(spark, SF).collect()}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in slow_lines(docs(spark))}
    assert got == want
