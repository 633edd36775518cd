"""Periodic runs against a brute-force search, and the query against a plain
restatement of its contract."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rinkspark.llm.periodic_runs import runs_of, with_runs
from rinkspark.llm.runs_queries import op12_periodic_runs

SF = os.environ.get("RINKSPARK_TEST_SF", "/root/testdata/sf0.001")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w):
    """Every maximal stretch of words equal at distance q, if q is its smallest period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_small_alphabets(w):
    assert runs_of(np.array(w, np.int64)) == brute(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_blocks(blocks):
    w = [x for block, n in blocks for x in block * n]
    assert runs_of(np.array(w, np.int64)) == brute(w)


def test_long_runs():
    one = np.zeros(30_000, np.int64)
    assert runs_of(one) == [(0, 30_000, 1)]
    rng = random.Random(3)
    head, cycle = [rng.randrange(50_000) for _ in range(5000)], [100_000 + rng.randrange(1000) for _ in range(700)]
    assert runs_of(np.array(head + cycle * 9 + cycle[:13] + head)) == [(5000, 6313, 700)]


def collapse(w):
    gone = {p for s, m, q in brute(w) for p in range(s + q, s + m)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_rows_stay_as_they_are(spark):
    long = "x " * 3 + "the quick brown fox " * 400
    texts = [None, "", " \n\t", "a a a a a", "a a a a a a", "a b a b a b a b a b a b a b", "ab " * 6 + "ab cd " * 4, long, long, "é é é é é é\x0bé"]
    rows = [(i % 4 or None, t, "r") for i, t in enumerate(texts)]
    df, n, runs, collapsed = with_runs(spark.createDataFrame(rows, "doc_id long, text string, _runs string"))
    got = sorted((str(r["text"]), r[n], [tuple(x) for x in r[runs]], r[collapsed]) for r in df.collect())
    want = []
    for t in texts:
        w = (t or "").encode().split()
        want.append((str(t), len(w), brute(w), b" ".join(collapse(w)).decode()))
    assert got == sorted(want)
    assert with_runs(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_equals_a_plain_restatement(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = (r.text or "").encode().split()
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines.encode()), digest(b" ".join(collapse(w)))))
    got = [tuple(r) for r in op12_periodic_runs(spark, SF).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert any(r[1] for r in got)
