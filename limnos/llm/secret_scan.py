"""Secret scans with corpus-wide ownership frequency.

Each text yields base spans by three fixed patterns and further candidates by
broader ones.  All candidates' value hashes are counted over the whole corpus
by distinct repositories and owners: the verdict is the effective number of
owners, each weighing its share r of the value's repositories (1 / sum of r^2).
A value spread evenly over many owners is a widely copied example; one that
stays with few, or with one but for stray copies, looks live, in however many
repositories of theirs it stands (so the verdict does not turn with the size of
the corpus).  Broader candidates become spans only when they look live; base
spans stay and carry the verdict.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, slices

# The patterns of the scan's contract.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS = 6, 20

# Broader candidates: token prefixes in public documentation, key blocks, mixed random strings.
WIDER = (("prefixed", re.compile(r"(?a:\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{12,}|sk_live_[A-Za-z0-9]{16,}"
                                 r"|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{20,}))")),
         ("jwt", re.compile(r"(?a:\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})")),
         ("key_block", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+?-----END [A-Z ]{0,30}PRIVATE KEY-----")),
         ("random", re.compile(r"(?a:(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-]))")))
ORDER = {k: i for i, k in enumerate((*KINDS, *(k for k, _ in WIDER)))}
MIN_ENTROPY = 3.8      # bits a character of a random candidate
MAX_OWNERS = 2         # most effective owners of a value that looks live

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the three base patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def wider_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Broader candidates that overlap no base span and none of an earlier kind."""
    out = []
    taken = [(s, e) for s, e, *_ in base]       # by start; a kind's matches come in order too
    for kind, pattern in WIDER:
        own, i, reach = [], 0, -1               # furthest end of the taken spans that start before this match
        for m in pattern.finditer(text):
            s, e = m.span()
            while i < len(taken) and taken[i][0] < e:
                reach = max(reach, taken[i][1])
                i += 1
            if reach > s:
                continue
            v = m[0]
            if kind == "random" and not (re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v)
                                         and entropy(v) >= MIN_ENTROPY):
                continue
            own.append((s, e, kind, v))
        out += own
        taken = list(heapq.merge(taken, [(s, e) for s, e, *_ in own]))
    return sorted(out)


_CAND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()),
                            ("value", pa.int64())]))


def _candidate_batches(batches):
    for b in slices(batches, "_text"):
        out = []
        for t in b.column("_text").to_pylist():
            base = base_spans(t) if t else []
            found = [(s, True) for s in base] + [(s, False) for s in (wider_spans(t, base) if t else [])]
            out.append([{"start": s, "end": e, "kind": k, "base": own,
                         "value": xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63)}
                        for (s, e, k, v), own in found])
        keep = [c for c in b.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, _CAND)], [*keep, "found"])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str | None = None, max_owners: float = MAX_OWNERS) -> DataFrame:
    """One row per row of ``df``: id, ``n_assign``, ``n_access``, ``n_hex``,
    ``base`` and ``spans`` (text ``kind:start:end`` by start, then kind, joined
    by commas), ``n_live`` and ``n_example`` (candidates by verdict).

    ``repo_col`` names a row's repository, that of the id if there is none.
    Null and empty texts have no spans.  A null owner is an owner of its own,
    a null repository one of its owner's.
    Null ids and repeated rows are rows like others.  Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    own = F.xxhash64(F.col(owner_col).isNull(), F.col(owner_col))
    repo = F.xxhash64(F.col(repo_col or id_col).isNull(), F.col(repo_col or id_col))
    rows = checkpointed(df.select(F.col(id_col).alias("_id"), own.alias("_own"), repo.alias("_repo"), F.col(text_col).alias("_text"))
                        .mapInArrow(_candidate_batches, f"_id {kind}, _own long, _repo long, found array<struct<"
                                    "start: long, end: long, kind: string, base: boolean, value: long>>"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())   # stable: the rows are checkpointed
    each = rows.select("_row", "_own", "_repo", F.inline("found"))
    repos = each.select("value", "_own", "_repo").distinct().groupBy("value", "_own").agg(F.count(F.lit(1)).cast("double").alias("n"))
    owners = repos.groupBy("value").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("owners"))
    live = owners.select("value", (F.col("owners") <= max_owners + 1e-9).alias("live"))
    place = F.struct("start", F.element_at(F.create_map(*[F.lit(x) for k in ORDER.items() for x in k]), F.col("kind")).alias("o"),
                     F.concat_ws(":", "kind", "start", "end").alias("s"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    count = lambda k: F.count_if(F.col("base") & (F.col("kind") == k))
    found = each.join(live, "value").groupBy("_row").agg(
        *[count(k).alias(f"n_{k}") for k in KINDS],
        joined(F.collect_list(F.when(F.col("base"), place))).alias("base"),
        joined(F.collect_list(F.when(F.col("base") | F.col("live"), place))).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("_row", F.col("_id").alias(id_col)).join(found, "_row", "left").select(
        id_col, *[n(f"n_{k}") for k in KINDS], F.coalesce("base", F.lit("")).alias("base"),
        F.coalesce("spans", F.lit("")).alias("spans"), n("n_live"), n("n_example"))
