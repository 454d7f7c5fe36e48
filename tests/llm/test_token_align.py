"""Tokenizer alignment against whole texts encoded at once."""

import hashlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from llm_rows import empty, frame, odd, odd_rows  # noqa: F401
from limnos.llm import queries, token_align

SF = "/root/testdata/sf0.001"
HARD = ["a\u2581b", "x  y \n\n  z ", "tab\t x", "\u65e5\u672c\u8a9e \u30c6\u30b9 \U0001F600\U0001F9FF", "<|endoftext|> a <0x41> <s> </s>",
        " lead", "trail ", "\n", "  ", "a\u3000b c", "it's don't 'S", "\r\n x\r", "\x1c \x85 q", "a\xa0 b", "a\u200b b", "\x00 z", "\u2581",
        "e\u0301 x\u0301", None, "", "1234 56.7,8 a1b2", "word." * 40, "ab" * 3000, "\U0001F9FF" * 50, "  " * 500 + "x"]


@pytest.fixture(scope="module")
def pair():
    return token_align.Pair(open(token_align.BYTE_BPE, "rb").read(), open(token_align.PIECE_BPE, "rb").read())


def slow_tokens(pair, text):
    """(A ids, A ends, B ids, B ends) of the text encoded as a whole."""
    if not text:
        return [], [], [], []
    raw = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    of = token_align.byte_of_char()
    a_bytes = [bytes(of[c] for c in pair.a.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(pair.b.id_to_piece(i)[3:5], 16)]) if pair.b.is_byte(i) else pair.b.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return [], [], [], []
    return a, np.cumsum([len(x) for x in a_bytes]).tolist(), b, np.cumsum([len(x) for x in b_bytes]).tolist()


def slow_groups(pair, text):
    a, ea, b, eb = slow_tokens(pair, text)
    cuts, out = set(ea) & set(eb), []
    left, right = list(zip(a, ea)), list(zip(b, eb))
    while left:
        sides = []
        for side in (left, right):
            n = next(i for i, (_, e) in enumerate(side) if e in cuts) + 1
            sides.append([i for i, _ in side[:n]])
            del side[:n]
        out.append(tuple(sides))
    return a, b, out


def slow_corpus(pair, texts):
    """Expected rows of the corpus, one per text."""
    docs = [slow_groups(pair, t) for t in texts]
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for _, _, groups in docs]
    count = Counter(p for held in links for p in held)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for (a, b, groups), held in zip(docs, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield (len(a), len(b), len(groups), sum(held.values()), sum(n for p, n in held.items() if count[p] == best[p[0]]),
               sum(n * count[p] for p, n in held.items()), hashlib.sha256(text.encode()).hexdigest() if a else "")


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(pair, df, monkeypatch=None):
    rows = df.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *w) for r, w in zip(rows, slow_corpus(pair, [r["text"] for r in rows])))
    got = Counter((r["doc_id"], *[r[c] for c in COLUMNS]) for r in token_align.align_corpus(df).collect())
    assert got == want


def test_hard_texts_match_brute_force(spark, pair):
    check(pair, frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(HARD)] + [(i, t, "en", "s", 1) for i, t in enumerate(HARD)]))


def test_odd_rows_match_brute_force(spark, pair):
    check(pair, frame(spark, [r for r in odd_rows() if len(r[1] or "") < 20000]))


def test_documents_match_brute_force(spark, pair):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(pair, docs)
    got = queries.op11_token_alignment(spark, SF)
    assert got.columns == ["doc_id", *COLUMNS] and got.count() == docs.count()


def test_small_chunks_caches_and_wide_groups_change_nothing(spark, pair, monkeypatch):
    for name, value in (("CHUNK_BYTES", 3000), ("SLICE", 1000), ("CACHE_UNITS", 50), ("BATCH_UNITS", 7), ("WIDE_GROUP", 2)):
        monkeypatch.setattr(token_align, name, value)
    texts = [t for t in HARD if len(t or "") < 3000] + [r[1] for r in odd_rows()[13:40]]
    cache, store = token_align.UnitCache(pair), []
    for i in range(0, len(texts), 5):
        part = texts[i:i + 5]
        stats, sha, _, _, links = token_align._align_slice(cache, part)
        store += [(*s, h) for s, h in zip(stats.T.tolist(), sha)]
        assert links.sum() == stats[3].sum()
    want = [(*w[:4], w[6]) for w in slow_corpus(pair, texts)]
    assert store == want


def test_coarse_spans_are_refined_inside_characters(pair):
    text = " h\u00e9llo \u65e5\u672c \U0001F9FF!"
    a, ea, b, eb = slow_tokens(pair, text[1:])
    got = pair.spans(text)
    assert [x.tolist() for x in got] == [a, ea, b, eb]
    ends = token_align.refined(np.array([0, 2, 2, 5]), np.array([2, 5, 5, 6]), np.array([2, 1, 2, 1]))
    assert ends.tolist() == [2, 3, 5, 6]


def test_spans_and_clashing_columns(spark, pair, empty):
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(HARD)]).withColumn("_id", F.lit("x")).withColumn("chunk", F.lit("y"))
    for r in token_align.token_spans(df).collect():
        a, ea, b, eb = slow_tokens(pair, HARD[r["doc_id"]])
        assert (r["a_ids"], r["a_ends"], r["b_ids"], r["b_ends"], r["cuts"]) == (a, ea, b, eb, sorted(set(ea) & set(eb)))
    assert token_align.align_corpus(df).count() == len(HARD)
    assert token_align.align_corpus(empty).count() == 0 and token_align.token_spans(empty).count() == 0


def test_other_kinds_of_tokenizers_are_refused():
    words = open("/opt/tokenizers/word_bpe_49k.json", "rb").read()
    with pytest.raises(ValueError):
        token_align.Pair(words, open(token_align.PIECE_BPE, "rb").read())


class Context:
    """Stands in for a task's context where a task's function runs here."""

    @staticmethod
    def get():
        return Context

    @staticmethod
    def partitionId():
        return 3


def chunk_rows(monkeypatch, texts, rows=50, **small):
    """What a task makes of a table whose ids are positions."""
    files = SimpleNamespace(value=tuple(open(p, "rb").read() for p in (token_align.BYTE_BPE, token_align.PIECE_BPE)))
    monkeypatch.setattr(token_align, "TaskContext", Context)
    for name, value in small.items():
        monkeypatch.setattr(token_align, name, value)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + rows, len(texts))), pa.int64()), pa.array(texts[i:i + rows], pa.string())],
                                          ["_id", "_text"]) for i in range(0, len(texts), rows)]
    return list(token_align._chunks(files)(iter(batches)))


def test_no_row_of_a_task_holds_a_whole_chunk(monkeypatch):
    texts = [" ".join(f"word{i}x{j % 40}" for j in range(200)) for i in range(400)]
    got = chunk_rows(monkeypatch, texts, CHUNK_BYTES=1 << 30)
    assert sum(b.num_rows - b.column("pair").null_count for b in got) == len(set(pa.Table.from_batches(got)["pair"].drop_null().to_pylist())) > 500
    for b in got:
        assert b.num_rows <= max(50, token_align.LIST_ROWS)
        assert max(sum(len(v) for v in (r["at"], r["links"]) if v) for r in b.to_pylist()) < 10000


def test_chunks_of_any_size_give_the_counts(pair, monkeypatch):
    texts = [t for t in HARD if len(t or "") < 3000] * 3 + [r[1] for r in odd_rows()[13:40]]
    want = list(slow_corpus(pair, texts))
    for size in (1, 3000, 1 << 30):
        table = pa.Table.from_batches(chunk_rows(monkeypatch, texts, 7, CHUNK_BYTES=size, LIST_ROWS=5))
        listed, docs = table.filter(pc.is_valid(table["pair"])), table.filter(pc.is_null(table["pair"]))
        chunks = sorted(set(docs["chunk"].to_pylist()))
        assert len(chunks) == 1 if size > 3000 else len(chunks) > 3
        count = Counter()
        for r in listed.to_pylist():
            count[r["pair"]] += r["docs"]
        top = defaultdict(int)
        for p, n in count.items():
            top[p // pair.n_b] = max(top[p // pair.n_b], n)
        got = {}
        for c in chunks:
            rows = [r for r in listed.to_pylist() if r["chunk"] == c]
            assert [r["pos"] for r in rows] == list(range(len(rows)))
            rows.reverse()
            right = pa.table({"pos": pa.array([r["pos"] for r in rows], pa.int32()), "count": pa.array([count[r["pair"]] for r in rows], pa.int64()),
                              "best": pa.array([count[r["pair"]] == top[r["pair"] // pair.n_b] for r in rows], pa.bool_())})
            for r in token_align._sum_counts(docs.filter(pc.equal(docs["chunk"], c)), right).to_pylist():
                got[r["_id"]] = tuple(r[x] for x in COLUMNS)
        assert [got[i] for i in range(len(texts))] == want


def test_documents_without_text_fill_a_chunk_too(monkeypatch):
    got = chunk_rows(monkeypatch, [None, ""] * 100, 10, CHUNK_BYTES=5000)
    assert sum(b.num_rows for b in got) == 200 and len({c for b in got for c in b.column("chunk").to_pylist()}) == 4


def test_cache_is_bounded_in_bytes(pair, monkeypatch):
    monkeypatch.setattr(token_align, "CACHE_BYTES", 20000)
    cache = token_align.UnitCache(pair)
    for i in range(10):
        text = " ".join(f"{i}{j}" * 200 for j in range(5))
        stats, sha, _, _, _ = token_align._align_slice(cache, [text])
        (want,) = slow_corpus(pair, [text])
        assert (*stats[:, 0].tolist(), sha[0]) == (*want[:4], want[6])
        assert len(cache.index) < 20


def test_packed_numbers_come_back():
    held = np.array([0, 2, 0, 3, 1, 0])
    for top in (1, 255, 256, 1 << 16, 1 << 32, 1 << 62):
        values = np.array([0, top, 1, top - 1, 0, top])
        rows = token_align.packed(values, held)
        assert token_align.unpacked(rows, held).tolist() == values.tolist()
    mixed = [token_align.packed(np.array(v), np.array([len(v)])) for v in ([1, 2], [], [300], [1 << 40, 5], [70000])]
    assert [len(x[0].as_py()) for x in mixed] == [2, 0, 2, 16, 4]
    assert token_align.unpacked(pa.concat_arrays(mixed), np.array([2, 0, 1, 2, 1])).tolist() == [1, 2, 300, 1 << 40, 5, 70000]


def test_tasks_of_a_process_share_the_models(monkeypatch):
    made = []
    monkeypatch.setattr(token_align, "_KEPT", {})
    monkeypatch.setattr(token_align, "Pair", lambda *f, real=token_align.Pair: made.append(1) or real(*f))
    first, again = (pa.Table.from_batches(chunk_rows(monkeypatch, ["a b", "x", None])) for _ in range(2))
    assert first.equals(again) and len(made) == 1
