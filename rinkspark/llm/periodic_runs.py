"""Periodic runs of words inside a text, by descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``max(6, 4 q)`` long, that no neighbouring word
extends keeping the period.

Per document, over its word numbers:

1. Suffixes are ordered by rank doubling; neighbours in that order give the
   longest common prefixes (LCP) by walking the doubled ranks down.
2. Neighbouring suffix classes are united by decreasing LCP (Kruskal with
   union-find). Every class keeps its text positions in order; the smaller
   class is dealt into the larger one.
3. Two positions i < j that become neighbours in a united class of LCP m are a
   seed if 3 (j - i) <= m: words i to j + m then have period j - i, four times
   at least. No smaller period can hold there, since a position in between
   would have joined the class earlier. The seed that cannot be moved left is
   the run, so each run is reported once.

A run repeats a run of five words (for q = 1: six equal words), so only
documents in which five words repeat are looked into; that test is one sort
of hashes over a batch of documents and can only let too many through.

Documents are independent: there is no shuffle, and a task holds a batch of
about 1 MB of text, or one longer document.

Defined results: a null, empty or blank text has no runs and collapses to the
empty text. Words are what ASCII white space separates. Rows are kept as they
are, ids (null or repeated) are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rinkspark.llm.common import free_name, map_texts
from rinkspark.llm.text_arrays import mixed

MIN_LENGTH = 6
MIN_REPEATS = 4
#: The shortest LCP between a run's first word and its next period.
MIN_LCP = 5

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_STEP = np.uint64(0x100000001B3)


def suffix_neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a word-number array in lexicographic order, and the LCP of
    each with the next one."""
    n = len(words)
    ranks, span = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    while ranks[-1].max() < n - 1:
        later = np.zeros(n, np.int64)
        later[: max(0, n - span)] = ranks[-1][span:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + later, return_inverse=True)[1].astype(np.int64))
        span *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    i, j = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank = np.append(ranks[level], -1)  # one past the end differs from all
        same = rank[np.minimum(i, n)] == rank[np.minimum(j, n)]
        step = same.astype(np.int64) << level
        lcp, i, j = lcp + step, i + step, j + step
    return order, lcp


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of an array of word numbers, by start,
    then period."""
    if len(words) < MIN_LENGTH:
        return []
    order, lcp = suffix_neighbours(words)
    edges = np.flatnonzero(lcp >= MIN_LCP)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def find(k: int) -> int:
        top = k
        while (up := parent.get(top, top)) != top:
            top = up
        while parent.get(k, k) != top:
            parent[k], k = top, parent.get(k, k)
        return top

    found: list[tuple[int, int, int]] = []
    for k, m in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = find(k), find(k + 1)
        large, small = places.pop(a, None) or [int(order[a])], places.pop(b, None) or [int(order[b])]
        if len(large) < len(small):
            large, small = small, large
        at = [bisect_left(large, x) for x in small]
        reach = m // (MIN_REPEATS - 1)
        for n, x in enumerate(small):
            p = at[n]
            if p and (n == 0 or at[n - 1] < p):
                i = large[p - 1]
                if x - i <= reach and m + x - i >= MIN_LENGTH and (i == 0 or words[i - 1] != words[x - 1]):
                    found.append((i, m + x - i, x - i))
            if p < len(large) and (n + 1 == len(small) or at[n + 1] > p):
                j = large[p]
                if j - x <= reach and m + j - x >= MIN_LENGTH and (x == 0 or words[x - 1] != words[j - 1]):
                    found.append((x, m + j - x, j - x))
        if len(small) * 16 < len(large):
            for x in small:
                insort(large, x)
        else:
            large = sorted(large + small)  # two ordered runs: linear
        parent[a] = b
        places[b] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def may_hold_runs(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which documents of a batch repeat a stretch of ``MIN_LCP`` words."""
    out = np.zeros(len(first) - 1, bool)
    n = len(codes) - MIN_LCP + 1
    if n <= 0:
        return out
    h = np.zeros(n, np.uint64)
    for k in range(MIN_LCP):
        h = mixed(h * _STEP + codes[k : n + k].astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    inside = owner == np.repeat(np.arange(len(first) - 1), np.diff(first))[MIN_LCP - 1 :]
    bits = np.uint64(max(1, int(len(first)).bit_length()))
    keys = np.sort((owner[inside].astype(np.uint64) << (np.uint64(64) - bits)) | (h[inside] >> bits))
    out[(keys[1:][keys[1:] == keys[:-1]] >> (np.uint64(64) - bits)).astype(np.int64)] = True
    return out


def _finder() -> Callable[[pa.Array], Sequence[pa.Array]]:
    def find(texts: pa.Array) -> Sequence[pa.Array]:
        split = [t.encode().split() for t in texts.to_pylist()]  # ASCII white space
        first = np.cumsum([0] + [len(w) for w in split])
        flat = pa.array([w for words in split for w in words], pa.binary())
        codes = flat.dictionary_encode().indices.to_numpy()
        flagged = may_hold_runs(codes, first)
        runs, kept = [], []
        for n, words in enumerate(split):
            own = runs_of(codes[first[n] : first[n + 1]]) if flagged[n] else []
            if own:
                change = np.zeros(len(words) + 1, np.int64)
                for start, length, period in own:
                    change[start + period] += 1
                    change[start + length] -= 1
                inside = np.cumsum(change)[:-1] > 0
                words = [w for w, gone in zip(words, inside.tolist(), strict=True) if not gone]
            runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
            kept.append(b" ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return [pa.array(np.diff(first), pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]

    return find


def with_runs(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns, and their names: the number of words,
    the runs (array of structs start, length, period, in words), and the text
    with every run reduced to its first period, words joined by one space."""
    n_words, runs, collapsed = (free_name(docs, c) for c in ("_n_words", "_runs", "_collapsed"))
    added = T.StructType([T.StructField(n_words, T.LongType()), T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])
    return map_texts(docs, text_col, _finder, added), n_words, runs, collapsed
