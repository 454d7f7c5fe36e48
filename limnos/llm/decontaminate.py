"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND.

Items are indexed in pieces of bounded size (``PIECE_WORDS``); a piece is what
is broadcast, and every training passage is run against every piece.  Impacts
are BM25 weights divided by the item's own score, so a passage that holds all
of an item's words scores 1.  A passage is a window of twice the piece's
longest item, moved by half its length, so every item lies whole in some
passage.  Bounds cut work and no results: first the passage's rare terms at
their maxima plus the most that common terms can give any item, then the block
maxima of all its terms, then WAND's pivot walk over the postings.  All items
with a score of ``threshold`` or more are retrieved and then verified; unless
it is given, it is the least that a passage covered to ``overlap`` can score:
five-word shingles of the question and of the answer must both be covered by
``overlap`` or more, or those of the whole item where no question mark parts it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

K1, B = 1.2, 0.75
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 2              # items of a block in the index
PIECE_WORDS = 200_000  # words of the items of a broadcast piece, about
MIN_WINDOW = 64
COMMON = 0.05          # share of a piece's items from which a term counts as common

_SPLIT = bytes((32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c) for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII other than letters and digits splits."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def question_answer(text: str | None) -> tuple[list[bytes], ...]:
    """Question and answer of an item, up to the first question mark and the
    rest; where they are not both there, the whole item as its only part."""
    head, mark, tail = (text or "").partition("?")
    q, a = words(head), words(tail)
    return (q, a) if mark and q and a else (words(text),)


def shingles(w: list[bytes], k: int = SHINGLE) -> set[tuple]:
    k = min(k, len(w))
    return set(zip(*[w[i:] for i in range(k)])) if k else set()


class Index:
    """BM25 impacts of a piece of items: postings by term, term and block maxima."""

    def __init__(self, items: list[tuple], block: int = BLOCK):
        self.items = sorted((x for x in items if any(x[1:])), key=lambda x: sum(map(len, x[1:])))  # alike in a block
        tokens = [[t for part in parts for t in part] for _, *parts in self.items]
        n = len(self.items)
        self.longest = max(map(len, tokens), default=0)
        mean = sum(map(len, tokens)) / n if n else 1.0
        df = Counter(t for w in tokens for t in set(w))
        self.vocab = {t: i for i, t in enumerate(df)}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in df]
        for i, w in enumerate(tokens):
            tf = Counter(w)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1)
                      / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                self.postings[self.vocab[t]].append((i, x / own))
        self.block = block
        self.top = np.array([max(x for _, x in p) for p in self.postings] + [0.0])
        self.block_top = [self._maxima(p) for p in self.postings]
        self.n_blocks = -(-n // block)
        self.off = np.cumsum([0, *map(len, self.block_top)])
        self.blocks = np.array([b for m in self.block_top for b in m], dtype=np.int64)
        self.maxima = np.array([x for m in self.block_top for x in m.values()])
        common = np.array([len(p) > COMMON * n for p in self.postings] + [True])
        self.rare_top = np.where(common, 0.0, self.top)
        mass = np.zeros(n)
        for p, often in zip(self.postings, common):
            for i, x in p if often else ():
                mass[i] += x
        self.common_mass = float(mass.max(initial=0.0))     # the most that common terms give an item
        self.wanted = [(shingles(parts[0]), shingles(parts[-1])) for _, *parts in self.items]

    def least_score(self, overlap: float) -> float:
        """A score that every passage reaches which covers the parts of an item
        to ``overlap``.  With a window of a part left, a word that the passage
        lacks on its left is the first of a broken window, one on its right the
        last: words lacking are no more than windows broken, and cost at most
        what the heaviest of them weigh."""
        weight: list[dict[bytes, float]] = [{} for _ in self.items]
        for t, v in self.vocab.items():
            for i, x in self.postings[v]:
                weight[i][t] = x
        least = 1.0
        for (_, *parts), own in zip(self.items, weight):
            tf = Counter(t for part in parts for t in part)
            lost = 0.0
            for part in filter(None, parts):
                k = min(SHINGLE, len(part))
                often = sorted(Counter(zip(*[part[i:] for i in range(k)])).values(), reverse=True)
                missing = min(len(often), int(len(often) * (1 - overlap) + 1e-9))
                broken = len(part) if missing == len(often) else sum(often[:missing])
                lost += sum(sorted((own[t] / tf[t] for t in part), reverse=True)[:broken])
            least = min(least, 1.0 - lost)
        return max(0.0, least - 1e-9)

    def _maxima(self, postings):
        out: dict[int, float] = {}
        for i, x in postings:
            out[i // self.block] = max(out.get(i // self.block, 0.0), x)
        return out

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items with a score of ``threshold`` or more: block-max WAND over
        the postings of the distinct ``terms``."""
        cur = [[self.postings[t][0][0], 0, t] for t in terms]
        out = []
        slack = 1e-9
        while cur:
            cur.sort()
            bound, p = 0.0, -1
            for k, c in enumerate(cur):
                bound += self.top[c[2]]
                if bound >= threshold - slack:
                    p = k
                    break
            if p < 0:
                break
            item = cur[p][0]
            while p + 1 < len(cur) and cur[p + 1][0] == item:
                p += 1
            blk = item // self.block
            if sum(self.block_top[c[2]].get(blk, 0.0) for c in cur[:p + 1]) < threshold - slack:
                to = (blk + 1) * self.block             # nothing of this block below the next list can reach it
                if p + 1 < len(cur):
                    to = min(to, cur[p + 1][0])
                self._advance(cur, p + 1, max(to, item + 1))
            elif cur[0][0] == item:
                score = sum(self.postings[c[2]][c[1]][1] for c in cur[:p + 1])
                if score >= threshold - slack:
                    out.append((item, score))
                self._advance(cur, p + 1, item + 1)
            else:
                self._advance(cur, p, item)
        return out

    def _block_bound(self, terms: np.ndarray) -> float:
        """The best block's sum of the terms' maxima: no item scores above it."""
        n = self.off[terms + 1] - self.off[terms]
        at = np.arange(n.sum()) + np.repeat(self.off[terms] - np.cumsum(n) + n, n)
        return float(np.bincount(self.blocks[at], self.maxima[at], self.n_blocks).max())

    def _advance(self, cur, n, to):
        for c in cur[:n]:
            post = self.postings[c[2]]
            while c[1] < len(post) and post[c[1]][0] < to:
                c[1] += 1
            c[0] = post[c[1]][0] if c[1] < len(post) else -1
        cur[:] = [c for c in cur if c[0] >= 0]

    def matches(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """Verified items of a text: (item, score, question and answer overlap, first word of the passage)."""
        w = words(text)
        if not w or not self.items:
            return []
        get = self.vocab.get
        ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        window = max(MIN_WINDOW, 2 * self.longest)
        step = window // 2
        starts = np.arange(0, max(1, len(w) - step), step)
        ends = np.minimum(starts + window, len(w))
        total = np.concatenate(([0.0], np.cumsum(self.rare_top[ids])))
        best: dict[int, tuple] = {}
        for k in np.flatnonzero(total[ends] - total[starts] + self.common_mass >= threshold - 1e-6).tolist():
            lo, hi = int(starts[k]), int(ends[k])
            terms = np.unique(ids[lo:hi])
            terms = terms[terms >= 0]
            if not len(terms) or self._block_bound(terms) < threshold - 1e-6:
                continue
            sets: dict[int, set] = {}
            found = self.search(terms.tolist(), threshold)
            for item, score in found:
                q, a = (self._covered(s, w[lo:hi], sets) for s in self.wanted[item])
                if q >= overlap and a >= overlap and (item not in best or (q + a, score) > best[item][:2]):
                    best[item] = (q + a, score, q, a, lo)
        return [(i, s, q, a, lo) for i, (_, s, q, a, lo) in sorted(best.items())]

    def _covered(self, wanted: set, passage: list[bytes], sets: dict) -> float:
        if not wanted:
            return 1.0
        k = len(next(iter(wanted)))
        if k not in sets:
            sets[k] = set(zip(*[passage[i:] for i in range(k)]))
        return len(wanted & sets[k]) / len(wanted)


def _match_batches(held, threshold: float | None, overlap: float):
    def run(batches):
        index = Index(held.value)
        least = index.least_score(overlap) if threshold is None else threshold
        for b in slices(batches, "_text"):
            row, got = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                for m in index.matches(t, least, overlap):
                    row.append(i)
                    got.append(m)
            if row:
                at = pa.array(row)
                item, score, q, a, lo = zip(*got)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").take(at), pa.array([index.items[i][0] for i in item], pa.int64()),
                     pa.array(score, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64()), pa.array(lo, pa.int64())],
                    ["_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_word"])
    return run


def _clean_batches(held, text_col: str, threshold: float | None, overlap: float):
    def run(batches):
        index = Index(held.value)
        least = index.least_score(overlap) if threshold is None else threshold
        for b in slices(batches, text_col):
            yield b.filter(pa.array([not index.matches(t, least, overlap) for t in b.column(text_col).to_pylist()]))
    return run


def _pieces(benchmark: DataFrame, item_col: str, item_text: str, piece_words: int):
    """Broadcasts of the items, a bounded piece at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull())
    chars = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    pieces = max(1, -(-chars // (6 * piece_words)))
    for p in range(pieces):
        rows = items.filter(F.pmod(F.xxhash64("t"), F.lit(pieces)) == p).orderBy("i", "t").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r["i"], *question_answer(r["t"])) for r in rows])


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", threshold: float | None = None,
               overlap: float = OVERLAP, piece_words: int = PIECE_WORDS) -> DataFrame:
    """A row for each row of ``df`` and item that it verifiably holds: id,
    ``item_id``, ``score``, ``question_overlap``, ``answer_overlap`` (both the
    whole item's where no question mark parts it) and ``passage_word`` (first
    word of the best passage).

    Null and empty texts hold nothing; items without words are held by
    nothing; a ``threshold`` that is given may pass over covered items; an empty benchmark or table gives no rows.  Parts of items under
    five words must occur whole.  Repeated rows and repeated items each count;
    null ids stay null.  Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, item_id long, score double, question_overlap double, answer_overlap double, passage_word long"
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for held in _pieces(benchmark, item_col, item_text, piece_words):
        got = docs.mapInArrow(_match_batches(held, threshold, overlap), schema)
        out = got if out is None else out.union(got)
    return out.withColumnRenamed("_id", id_col)


def drop_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", threshold: float | None = None, overlap: float = OVERLAP,
               piece_words: int = PIECE_WORDS) -> DataFrame:
    """The rows of ``df``, all columns, that hold no item (a filter: nothing is shuffled)."""
    for held in _pieces(benchmark, item_col, item_text, piece_words):
        df = df.mapInArrow(_clean_batches(held, text_col, threshold, overlap), df.schema)
    return df
