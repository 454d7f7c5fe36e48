"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE (``tokenizers``), B a SentencePiece model with
byte fallback.  A's character offsets and B's spans are the coarse cuts; tokens
that end inside a character (parts of a multibyte character, byte-fallback
tokens) are cut by their decoded bytes.  Byte offsets where tokens of both end
divide a text into groups, and every A token of a group is linked to every B
token of it.

A space that follows a character other than white space starts a new token in
both tokenizers (``Pair`` checks that the models are of that kind), so texts are
cut there into units and each distinct unit is aligned once per cache.

An id pair's count is the number of documents that hold it linked.  A text's
counts need the whole corpus: texts are encoded once, in chunks that keep each
document's distinct pairs as positions in the chunk's own pair list.  A
document is a row and so is a pair of a list, and rows leave the task with the
slice that made them.  The lists are counted by pair, the counts travel back to
the chunks by a join, and a cogroup sums them per document, so what meets in a
task is one chunk.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import binary, flat, shared_path, slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 1 << 20          # bytes of text encoded at a time
CHUNK_BYTES = 8 << 20    # bytes of text whose pairs are counted together before they shuffle
ROW_BYTES = 100          # what a document counts for in a chunk besides its text
LIST_ROWS = 1 << 14      # pairs of a list given out at a time
CACHE_UNITS = 1 << 18    # distinct units a task remembers
CACHE_BYTES = 64 << 20   # bytes of them
BATCH_UNITS = 1 << 13    # units aligned at a time
WIDE_GROUP = 1 << 16     # links of a group from which they are made by distinct ids
LEAD = " a"              # a unit before the others, so that each has one before it

# A cut stands before a space, unless a character that some tokenizer may take
# for white space, or U+2581 itself, comes before it.
_BLANK = r"\s\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿▁"
_CUT = re.compile(f" (?<![{_BLANK}] )")
_OPEN_END = re.compile(f"[{_BLANK}]$")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones themselves, the others in order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def units_of(text: str) -> list[str]:
    """The units of space + text, each without its first space."""
    return _CUT.split(" " + text)[1:]


class Pair:
    """Both tokenizers, from the bytes of their files, with the bytes of every
    token.  Raises where a unit might not be encoded alone as within its text."""

    def __init__(self, a_file: bytes, b_file: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        spec = json.loads(a_file)
        pre = spec.get("pre_tokenizer") or {}
        if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True)
                or pre.get("add_prefix_space")):
            raise ValueError("tokenizer A is not a byte-level BPE that splits before spaces")
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("tokenizer B has pieces that reach over a space")
        of = byte_of_char()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.n_b = len(pieces)
        marks = ((b",", b"|"), (b",", b";"))
        self.names = [np.array([b"%d" % i + m for m in ms for i in range(n)], dtype=object)
                      for ms, n in zip(marks, (len(self.a_bytes), self.n_b))]
        self.name_len = [np.array([len(x) for x in t], dtype=np.int64) for t in self.names]

    def gives_back(self, raw: bytes, ids_a: np.ndarray, ids_b: np.ndarray) -> bool:
        a, b = self.a_bytes, self.b_bytes
        return b"".join([a[i] for i in ids_a.tolist()]) == raw and b"".join([b[i] for i in ids_b.tolist()]) == raw

    def ascii_spans(self, units: list[str]) -> tuple | None:
        """As ``spans`` of ``LEAD`` and ASCII units: with one byte a character
        and no byte fallback inside one, the decoded bytes are the spans."""
        text = LEAD + "".join([" " + u for u in units])
        ids_a = np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        ids_b = np.fromiter(chain.from_iterable(self.b.encode([LEAD[1:], *units], return_type=int, num_threads=1)), dtype=np.int64)
        if not self.gives_back(text.encode(), ids_a, ids_b):
            return None
        return ids_a, np.cumsum(self.a_len[ids_a]), ids_b, np.cumsum(self.b_len[ids_b])

    def spans(self, text: str) -> tuple | None:
        """(A ids, A ends, B ids, B ends), ends in bytes of ``text``, which
        begins with a space; None if a tokenizer's bytes are not the text's."""
        got = self.a.encode(text, add_special_tokens=False)
        ids_a = np.array(got.ids, dtype=np.int64)
        off = np.fromiter(chain.from_iterable(got.offsets), dtype=np.int64, count=2 * len(ids_a)).reshape(-1, 2)
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        at = np.zeros(len(cp) + 1, dtype=np.int64)
        np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        own = np.array([(p.id, p.begin, p.end) for p in pieces], dtype=np.int64).reshape(-1, 3)
        ids_b = own[:, 0]
        if not self.gives_back(text.encode(), ids_a, ids_b):
            return None
        ends_a = refined(at[off[:, 0]], at[off[:, 1]], self.a_len[ids_a])
        return ids_a, ends_a, ids_b, refined(own[:, 1] + 1, own[:, 2] + 1, self.b_len[ids_b])


_KEPT: dict = {}


def kept_pair(files: tuple[bytes, bytes]) -> Pair:
    """The pair of these files, made once a process: what a tokenizer caches of
    new words stays in memory when it is dropped."""
    if _KEPT.get("files") != files:
        _KEPT.update(files=files, pair=Pair(*files))
    return _KEPT["pair"]


def refined(start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse spans: a token that ends where the next
    one starts keeps its end; any other (one of several in a character) ends by
    the decoded bytes since the last such cut."""
    n = len(end)
    if not n:
        return end
    clean = np.ones(n, dtype=bool)
    clean[:-1] = (end[:-1] == start[1:]) & (end[1:] > start[1:]) & (end[:-1] > start[:-1])
    total = np.cumsum(size)
    last = np.maximum.accumulate(np.where(clean, np.arange(n), -1))
    shift = np.where(last >= 0, end[last] - total[last], 0)
    return total + shift


def common_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Ends that both lists (in order, without repeats) hold."""
    if not len(ends_b):
        return ends_b
    at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    return ends_a[ends_b[at] == ends_a]


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as hold them all."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next((t for t in (np.uint8, np.uint16, np.uint32) if top <= np.iinfo(t).max), np.int64))


class Aligned:
    """What a batch of units gives: counts, digest pieces, distinct id pairs."""

    def __init__(self, n_a, n_b, n_groups, n_links, valid, digests, pair_at, pairs, mult):
        self.n_a, self.n_b, self.n_groups, self.n_links = map(narrow, (n_a, n_b, n_groups, n_links))
        self.valid, self.digests, self.pair_at, self.pairs, self.mult = valid, digests, pair_at, narrow(pairs), narrow(mult)


def _invalid(n: int) -> Aligned:
    z = np.zeros(n, dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    return Aligned(z, z, z, z, np.zeros(n, dtype=bool), [b""] * n, np.zeros(n + 1, dtype=np.int64), none, none)


def _concat(parts: list[Aligned]) -> Aligned:
    cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
    at, base = [np.zeros(1, dtype=np.int64)], 0
    for p in parts:
        at.append(p.pair_at[1:] + base)
        base += len(p.pairs)
    return Aligned(cat("n_a"), cat("n_b"), cat("n_groups"), cat("n_links"), cat("valid"),
                   [d for p in parts for d in p.digests], np.concatenate(at), cat("pairs"), cat("mult"))


def _links(ids_a, ga, ids_b, gb, n_a, n_b, unit, width, n_b_ids):
    """Distinct (unit, pair) of all links with their numbers; ``unit`` is each
    group's.  A wide group is multiplied out by its distinct ids only."""
    wide = n_a * n_b > WIDE_GROUP
    start_b = np.cumsum(n_b) - n_b
    mine = np.flatnonzero(~wide[ga])
    g = ga[mine]
    times = n_b[g]
    first = np.repeat(np.cumsum(times) - times, times)
    ib = np.repeat(start_b[g], times) + np.arange(len(first)) - first
    keys = [np.repeat(unit[g] * width + ids_a[mine] * n_b_ids, times) + ids_b[ib]]
    nums = [np.ones(len(ib), dtype=np.int64)]
    for w in np.flatnonzero(wide).tolist():
        ua, ca = np.unique(ids_a[ga == w], return_counts=True)
        ub, cb = np.unique(ids_b[gb == w], return_counts=True)
        keys.append((unit[w] * width + ua[:, None] * n_b_ids + ub).ravel())
        nums.append((ca[:, None] * cb).ravel())
    return summed(np.concatenate(keys), np.concatenate(nums))


def summed(keys: np.ndarray, nums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their numbers."""
    if not len(keys):
        return keys, nums
    order = np.argsort(keys, kind="stable")
    keys, nums = keys[order], nums[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(nums, at)


def align_units(pair: Pair, units: list[str]) -> Aligned:
    """Align units that may stand one after the other in one text."""
    n = len(units)
    plain = all(map(str.isascii, units)) and "" not in units
    got = pair.ascii_spans(units) if plain else pair.spans(LEAD + "".join([" " + u for u in units]))
    size = np.array([len(u.encode()) + 1 for u in units], dtype=np.int64)
    ends = np.cumsum(size) + len(LEAD)
    if got is not None:
        ids_a, ends_a, ids_b, ends_b = got
        cuts = common_cuts(ends_a, ends_b)
        if len(common_cuts(ends, cuts)) < n:
            got = None
    if got is None:
        if n == 1:
            return _invalid(1)
        return _concat([align_units(pair, units[:n // 2]), align_units(pair, units[n // 2:])])
    own_a, own_b = ends_a > len(LEAD), ends_b > len(LEAD)
    ids_a, ends_a, ids_b, ends_b = ids_a[own_a], ends_a[own_a], ids_b[own_b], ends_b[own_b]
    cuts = cuts[cuts > len(LEAD)]
    ga, gb = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    n_a, n_b = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
    unit = np.searchsorted(ends, cuts)
    per_unit = lambda w: np.bincount(unit, weights=w, minlength=n).astype(np.int64)
    # digest: A ids of a group, then its B ids; the last of a side ends with | or ;
    last_a = np.concatenate((ga[1:] != ga[:-1], [True]))
    last_b = np.concatenate((gb[1:] != gb[:-1], [True]))
    row_a, row_b = ids_a + last_a * len(pair.a_bytes), ids_b + last_b * pair.n_b
    order = np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")
    text = b"".join(np.concatenate((pair.names[0][row_a], pair.names[1][row_b]))[order].tolist())
    written = (np.bincount(unit[ga], weights=pair.name_len[0][row_a], minlength=n)
               + np.bincount(unit[gb], weights=pair.name_len[1][row_b], minlength=n)).astype(np.int64)
    to = np.cumsum(written).tolist()
    digests = [text[i:j] for i, j in zip([0, *to[:-1]], to)]
    width = len(pair.a_bytes) * pair.n_b
    keys, mult = _links(ids_a, ga, ids_b, gb, n_a, n_b, unit, width, pair.n_b)
    at = np.searchsorted(keys, np.arange(n + 1) * width)
    return Aligned(per_unit(n_a), per_unit(n_b), per_unit(np.ones(len(cuts))), per_unit(n_a * n_b), np.ones(n, dtype=bool),
                   digests, at, keys % width, mult)


class UnitCache:
    """Aligned units by their text; emptied when it is full."""

    def __init__(self, pair: Pair):
        self.pair, self.index, self.store, self.size = pair, {}, None, 0

    def look_up(self, lists: list[list[str]]) -> list[list[int]]:
        """Unit numbers of each text's units, aligning those not yet known."""
        if len(self.index) > CACHE_UNITS or self.size > CACHE_BYTES:
            self.index, self.store, self.size = {}, None, 0
        index = self.index
        new = [u for u in dict.fromkeys(chain.from_iterable(lists)) if u not in index]
        # a unit that ends in white space is the last of its text, one with U+2581 never gives its bytes back
        first = len(index)
        parts, runs = [] if self.store is None else [self.store], ([], [])
        for u in new:
            if "▁" in u:
                parts.append(_invalid(1))
            elif not u or _OPEN_END.search(u):
                parts.append(align_units(self.pair, [u]))
            else:
                runs[u.isascii()].append(u)
                continue
            index[u] = first
            first += 1
        for run in runs:
            for i in range(0, len(run), BATCH_UNITS):
                parts.append(align_units(self.pair, run[i:i + BATCH_UNITS]))
            index.update(zip(run, range(first, first + len(run))))
            first += len(run)
        if new:
            made = parts if self.store is None else parts[1:]
            self.size += sum(map(sys.getsizeof, new)) + sum(sum(map(sys.getsizeof, p.digests)) + p.pairs.nbytes + p.mult.nbytes for p in made)
            self.store = _concat(parts)
        return [[index[u] for u in units] for units in lists]


def _align_slice(cache: UnitCache, texts: list[str | None]):
    """Per text: n_a, n_b, n_groups, n_links, digest; and (text, pair, links)
    of all distinct linked pairs, in order."""
    numbers = cache.look_up([units_of(t) if t else [] for t in texts])
    s, n = cache.store, len(texts)
    width = len(cache.pair.a_bytes) * cache.pair.n_b
    stats, sha = np.zeros((4, n), dtype=np.int64), [""] * n
    if s is None:
        none = np.zeros(0, dtype=np.int64)
        return stats, sha, none, none, none
    doc = np.repeat(np.arange(n), [len(x) for x in numbers])
    unit = np.fromiter(chain.from_iterable(numbers), dtype=np.int64, count=len(doc))
    ok = np.bincount(doc, weights=~s.valid[unit], minlength=n) == 0
    mine = ok[doc]
    doc, unit = doc[mine], unit[mine]
    for j, x in enumerate((s.n_a, s.n_b, s.n_groups, s.n_links)):
        stats[j] = np.bincount(doc, weights=x[unit], minlength=n)
    for i, units in enumerate(numbers):
        if units and ok[i]:
            sha[i] = hashlib.sha256(b"".join([s.digests[u] for u in units])[:-1]).hexdigest()
    total = len(s.n_a)
    key, times = summed(doc * total + unit, np.ones(len(doc), dtype=np.int64))
    doc, unit = key // total, key % total
    size = s.pair_at[unit + 1] - s.pair_at[unit]
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(s.pair_at[unit], size) + np.arange(len(first)) - first
    key, links = summed(np.repeat(doc, size) * width + s.pairs[at], np.repeat(times, size) * s.mult[at])
    return stats, sha, key // width, key % width, links


_STATS = ("n_a", "n_b", "n_groups", "n_links")


class PairList:
    """The distinct pairs of a chunk, in the order in which slices bring them,
    with the number of documents that hold each."""

    def __init__(self):
        self.known, self.pos, self.docs = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, pairs: np.ndarray) -> np.ndarray:
        """Positions of the pairs of further documents, none twice in one."""
        mine, of, docs = np.unique(pairs, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.known, mine)
        new = np.ones(len(mine), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != mine[inside]
        n, more = len(self.known), int(new.sum())
        self.known = np.insert(self.known, at[new], mine[new])
        self.pos = np.insert(self.pos, at[new], np.arange(n, n + more))
        self.docs = np.concatenate((self.docs, np.zeros(more, dtype=np.int64)))
        pos = self.pos[np.searchsorted(self.known, mine)]
        self.docs[pos] += docs
        return pos[of]

    def pairs(self) -> np.ndarray:
        """All pairs by position."""
        out = np.empty(len(self.known), dtype=np.int64)
        out[self.pos] = self.known
        return out


def packed(values: np.ndarray, held: np.ndarray) -> pa.Array:
    """Numbers from 0 on, ``held`` of them a row, as the bytes of the narrowest
    kind that holds them all."""
    values = narrow(values)
    ends = np.concatenate(([0], np.cumsum(held))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(held), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def unpacked(col: pa.Array, held: np.ndarray) -> np.ndarray:
    """What ``packed`` had, from rows that may be of different widths."""
    buf, off = flat(col)
    size = np.diff(off)
    width = size // np.maximum(held, 1)
    out = np.empty(int(held.sum()), dtype=np.int64)
    for w in np.unique(width[held > 0]).tolist():
        out[np.repeat(width == w, held)] = buf[np.repeat(width == w, size)].view(f"u{w}" if w < 8 else "i8")
    return out


def _document_rows(chunk: int, ids: pa.Array, part: tuple, listed: PairList) -> pa.RecordBatch:
    stats, sha, doc, pairs, links = part
    held = np.bincount(doc, minlength=len(ids))
    none = [pa.nulls(len(ids), pa.int64())] * 2
    cols = [pa.array(np.full(len(ids), chunk)), ids, *map(pa.array, stats), pa.array(sha, pa.string()), pa.array(held),
            packed(listed.add(pairs), held), packed(links, held), pa.nulls(len(ids), pa.int32()), *none]
    return pa.RecordBatch.from_arrays(cols, _COLUMNS)


def _list_rows(chunk: int, kind: pa.DataType, listed: PairList):
    pairs, docs = listed.pairs(), listed.docs
    for i in range(0, len(pairs), LIST_ROWS):
        own = pairs[i:i + LIST_ROWS]
        n = len(own)
        none = [pa.nulls(n, t) for t in (kind, *[pa.int64()] * len(_STATS), pa.string(), pa.int64(), pa.binary(), pa.binary())]
        cols = [pa.array(np.full(n, chunk)), *none, pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(own), pa.array(docs[i:i + n])]
        yield pa.RecordBatch.from_arrays(cols, _COLUMNS)


_COLUMNS = ["chunk", "_id", *_STATS, "sha", "held", "at", "links", "pos", "pair", "docs"]


def _give_back() -> None:
    """Hand freed memory back to the system: a worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _chunks(files):
    def rows(batches):
        cache = UnitCache(kept_pair(files.value))
        task, seq = TaskContext.get().partitionId() << 32, 0
        listed, size, kind = PairList(), 0, None
        for b in slices(batches, "_text", SLICE):
            ids, kind = b.column("_id"), b.column("_id").type
            yield _document_rows(task | seq, ids, _align_slice(cache, b.column("_text").to_pylist()), listed)
            size += ROW_BYTES * len(ids) + (pc.sum(pc.binary_length(binary(b.column("_text")))).as_py() or 0)
            if size >= CHUNK_BYTES:
                yield from _list_rows(task | seq, kind, listed)
                listed, size, seq = PairList(), 0, seq + 1
        if size:
            yield from _list_rows(task | seq, kind, listed)

    def run(batches):
        yield from rows(batches)
        _give_back()
    return run


def _sum_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents with the counts of its pairs: sums per document."""
    left, right = left.combine_chunks(), right.combine_chunks()
    row = {n: left.column(n).combine_chunks() for n in left.schema.names}
    held = row["held"].to_numpy(zero_copy_only=False).astype(np.int64)
    at, links = unpacked(row["at"], held), unpacked(row["links"], held)
    count, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=bool)
    pos = right.column("pos").to_numpy()
    count[pos], best[pos] = right.column("count").to_numpy(), right.column("best").to_numpy()
    ends = np.concatenate(([0], np.cumsum(held)))
    per_doc = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])
    return pa.Table.from_arrays(
        [row["_id"], *[row[n] for n in _STATS], pa.array(per_doc(links * best[at])), pa.array(per_doc(links * count[at])), row["sha"]],
        ["_id", *_STATS, "n_best", "count_sum", "groups_sha256"])


def tokenizer_files(spark: SparkSession, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE):
    """Both vocabulary files as a broadcast (their size is fixed)."""
    out = []
    for p in (a_path, b_path):
        with open(p, "rb") as f:
            out.append(f.read())
    return spark.sparkContext.broadcast(tuple(out))


def align_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE,
                 b_path: str = PIECE_BPE) -> DataFrame:
    """One row per row of ``df``: id, ``n_a``, ``n_b`` (tokens), ``n_groups``,
    ``n_links`` (linked token pairs), ``n_best`` (links whose id pair's count is
    the highest of its A id in the corpus, ties included), ``count_sum`` (counts
    summed over links) and ``groups_sha256`` (of ``a1,a2|b1;a3|b2`` in order).

    Null and empty texts, and texts that a tokenizer's bytes don't give back
    (U+2581 reads as a space), have zeros and an empty digest, and count for no
    pair.  Repeated rows each count as a document; null ids are ids like others.
    An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    files = tokenizer_files(spark, a_path, b_path)
    n_b = Pair(*files.value).n_b
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    path = shared_path(spark, "token-align")
    rows.mapInArrow(_chunks(files), f"chunk long, _id {kind}, {', '.join(f'{n} long' for n in _STATS)}, sha string, held long, "
                                    "at binary, links binary, pos int, pair long, docs long").write.parquet(path)
    chunks = spark.read.parquet(path)
    listed = chunks.filter(F.col("pair").isNotNull()).select("chunk", "pos", "pair", "docs")
    held = chunks.filter(F.col("pair").isNull()).drop("pos", "pair", "docs")
    totals = listed.groupBy("pair").agg(F.sum("docs").alias("count"))
    a_id = F.floor(F.col("pair") / n_b)
    top = totals.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("top"))       # at most A's vocabulary
    scored = totals.withColumn("a_id", a_id).join(F.broadcast(top), "a_id") \
                   .select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    answers = listed.join(scored, "pair").select(F.col("chunk").alias("of"), "pos", "count", "best")
    out = held.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(
        _sum_counts, f"_id {kind}, {', '.join(f'{n} long' for n in _STATS)}, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("_id", id_col)


def _span_batches(files):
    def run(batches):
        pair = kept_pair(files.value)
        for b in slices(batches, "_text", SLICE):
            rows = []
            for t in b.column("_text").to_pylist():
                got = pair.spans(" " + t) if t else None
                rows.append([x.tolist() for x in (*got, common_cuts(got[1], got[3]))] if got else [[]] * 5)
            yield pa.RecordBatch.from_arrays([b.column("_id"), *[pa.array([r[j] for r in rows], pa.list_(pa.int64())) for j in range(5)]],
                                             ["_id", "a_ids", "a_ends", "b_ids", "b_ends", "cuts"])
    return run


def token_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE,
                b_path: str = PIECE_BPE) -> DataFrame:
    """One row per row of ``df``: id, ids and byte ends (in space + text) of both
    tokenizers' tokens, and ``cuts``, the ends of the groups.  Texts without
    tokens (see ``align_corpus``) have empty lists; no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _span_batches(tokenizer_files(df.sparkSession, a_path, b_path)),
        f"_id {kind}, a_ids array<long>, a_ends array<long>, b_ids array<long>, b_ends array<long>, cuts array<long>")
    return out.withColumnRenamed("_id", id_col)
