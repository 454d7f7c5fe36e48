"""License scans with a generalised suffix automaton over licence tokens.

The automaton holds every substring of the phrase and notice templates.  A
file's tokens stream through it and give matching statistics: at each token
the longest template substring that ends there.  Full phrases are read off the
suffix links (exact places); long matches are chained per notice (in order in
file and template, gaps allowed) into covered template spans, and a notice is
labelled when a chain covers enough of it.  A notice that stands in a file
several times gives a span for each place.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, texts

# The phrases and labels of the scan's contract.
PHRASES = (("under the mit license", "mit"),
           ("apache license version 2", "apache-2"),
           ("cc by nc", "cc-by-nc"))

# Opening notices of public licence texts.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
              "was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
)

MIN_MATCH = 4      # shortest match, in tokens, that joins a chain
MAX_GAP = 12       # widest gap between chained matches, in tokens of the file
MIN_COVER = 0.7    # covered share of a notice from which it is labelled

# A-Z to lower case; what is not a letter, digit or non-ASCII byte splits words.
_WORD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32)
              for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


class Automaton:
    """Generalised suffix automaton over token-id sequences."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]   # (template, end) of prefixes that reach the state
        for t, seq in enumerate(templates):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].append((t, i + 1))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] += self.ends[v]
        self.ends[0] = []

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:                      # the substring is there from another template
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """Matching statistics after one more token."""
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], n + 1
        return 0, 0


class Scanner:
    """The automaton of phrases and notices, with the phrases that end at each state."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, min_match: int = MIN_MATCH,
                 max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        templates = [*phrases, *((text, label) for label, text in notices)]
        seqs = [words(t.encode()) for t, _ in templates]
        self.labels = [x for _, x in templates]
        self.n_phrases, self.lengths = len(phrases), [len(s) for s in seqs]
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
        self.auto = Automaton([[self.vocab[w] for w in s] for s in seqs])
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.shortest = min(min_match, *self.lengths[:self.n_phrases]) if phrases else min_match
        self.whole = [[(t, self.lengths[t]) for t, e in ends if t < self.n_phrases and e == self.lengths[t]]
                      for ends in self.auto.ends]

    def scan(self, tokens: list[bytes]):
        """(base places [(start, phrase)], notice spans [(start, end, notice, covered share)])."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        known = np.flatnonzero(ids >= 0)
        if len(known) < self.shortest:
            return [], []
        breaks = np.flatnonzero(np.diff(known) > 1) + 1
        runs = zip(np.concatenate(([0], breaks)).tolist(), np.concatenate((breaks, [len(known)])).tolist())
        places, matches = [], []
        for lo, hi in runs:
            if hi - lo < self.shortest:
                continue
            self._run(ids[known[lo]:known[lo] + hi - lo].tolist(), int(known[lo]), places, matches)
        return places, self._chains(matches)

    def _run(self, ids, base, places, matches):
        auto = self.auto
        state = n = 0
        for j, c in enumerate(ids):
            was, had = state, n
            state, n = auto.step(state, n, c)
            if had >= self.min_match and n <= had:        # the match that ended at j - 1 cannot grow
                matches.append((base + j - had, base + j, was))
            v = state
            while v > 0:
                for t, length in self.whole[v]:
                    if length <= n and self._ends_here(v, t, length):
                        places.append((base + j + 1 - length, t))
                v = auto.link[v]
        if n >= self.min_match:
            matches.append((base + len(ids) - n, base + len(ids), state))

    def _ends_here(self, v: int, t: int, length: int) -> bool:
        link = self.auto.link[v]
        return self.auto.length[link] < length <= self.auto.length[v]

    def _chains(self, matches):
        """Chains of each notice that cover enough of it, none over another of
        the same notice: the most template tokens covered in order first, then
        on over what is left of the matches outside."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, v in matches:
            for t, e in self.auto.ends[v]:
                if t >= self.n_phrases:
                    by.setdefault(t, []).append((start, end, e))
        spans = []
        for t, ms in by.items():
            ms = sorted(set(ms))
            while ms:
                taken: list[tuple[int, int]] = []
                for cover, start, end in sorted(self._best_chains(t, ms), key=lambda x: -x[0]):
                    at = bisect_left(taken, (start, end))
                    if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                        taken.insert(at, (start, end))
                        spans.append((start, end, t, min(1.0, cover / self.lengths[t])))
                ms = self._outside(ms, taken) if taken else []
        return sorted(spans)

    def _best_chains(self, t: int, ms: list[tuple[int, int, int]]):
        """(covered tokens, start, end) of the best chain to each match, where it covers enough."""
        best: list[tuple[int, int]] = []                   # covered tokens, start of the chain
        first = 0
        for i, (s, e, te) in enumerate(ms):
            got = (e - s, s)
            while first < i and ms[first][1] + self.max_gap < s and ms[first][0] + self.lengths[t] + self.max_gap < s:
                first += 1
            for k in range(first, i):
                ps, pe, pte = ms[k]
                over = max(0, pe - s, pte - (te - (e - s)))
                if pe < e and pte < te and ps < s and s - pe <= self.max_gap and e - s > over:
                    got = max(got, (best[k][0] + e - s - over, best[k][1]))
            best.append(got)
            if min(1.0, got[0] / self.lengths[t]) >= self.min_cover:
                yield got[0], got[1], e

    def _outside(self, ms: list[tuple[int, int, int]], taken: list[tuple[int, int]]):
        """The stretches of the matches outside the taken spans, of ``min_match`` or more."""
        out = set()
        for s, e, te in ms:
            at = s
            k = max(0, bisect_left(taken, (s, s)) - 1)
            while k < len(taken) and taken[k][0] < e:
                lo, hi = taken[k]
                if lo - at >= self.min_match:
                    out.add((at, lo, te - (e - lo)))
                at = max(at, hi)
                k += 1
            if e - at >= self.min_match:
                out.add((at, e, te))
        return sorted(out)

    def row(self, text: bytes | None):
        tokens = words(text)
        places, spans = self.scan(tokens)
        base = sorted({self.labels[t] for _, t in places})
        starts = [s for s, _ in places]
        found = sorted({*base, *(self.labels[t] for *_, t, _ in spans)})
        score = 1.0 if places else max((c for *_, c in spans), default=0.0)
        return (len(tokens), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
                ",".join(found), score,
                json.dumps([[s, e, self.labels[t], round(c, 4)] for s, e, t, c in spans]) if spans else "[]")


_OUT = (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
        ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", "string"))
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _scan_batches(**params):
    def run(batches):
        scanner = Scanner(**params)
        for b in slices(batches, "_text"):
            cols = zip(*[scanner.row(t) for t in texts(b.column("_text"))])
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *[pa.array(c, _ARROW[k]) for c, (_, k) in zip(cols, _OUT)]],
                ["_id", *[n for n, _ in _OUT]])
    return run


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per row of ``df``: id, ``n_words``, ``n_base`` (places of whole
    phrases), ``first_word`` / ``last_word`` (their smallest and largest start;
    null without places), ``base_labels``, ``labels`` (with those of covered
    notices), ``score`` (1 with a phrase, else the best covered share of at
    least ``min_cover``, else 0) and ``spans`` (JSON: start, end, label, share;
    one for each place of a notice, those of the same notice not overlapping).

    Null and empty texts: no words, no labels, score 0.  Null ids and repeated
    rows are rows like others.  Other columns are not read.  ``params`` go to
    ``Scanner`` (phrases, notices, min_match, max_gap, min_cover).
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _scan_batches(**params), f"_id {kind}, " + ", ".join(f"{n} {k}" for n, k in _OUT))
    return out.withColumnRenamed("_id", id_col)
