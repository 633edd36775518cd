"""Personal data: base spans against the plain expressions, scores against a
plain restatement of the graph, and what the patterns find."""

import hashlib
import math
import os
import random
import re
from collections import defaultdict

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from rinkspark.llm import private_data as P
from rinkspark.llm.private_queries import op13_private_data

SF = os.environ.get("RINKSPARK_TEST_SF", "/root/testdata/sf0.001")
PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            check = sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and check % 10 == 0)
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@- 1205+()é%\n", max_size=60))
@example("a@b.cd@e.fg a.@x.y.z -@a-.b")
@example("1.2.3.4.5.6.7.8 256.1.1.1.1 1.2.3.004")
@example("4111 1111-1111 1111 4111111111111111 +1 (555) 555-0100 +1 (2")
@example("0" * 13 + " " + "0" * 20 + "-" + "12 " * 9)
def test_base_spans_equal_the_plain_expressions(text):
    assert P.base_spans(text) == plain(text)


def test_long_unbroken_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "a" * 100_000 + "@" * 100_000, "1." * 100_000, "+1" * 100_000, "+" + "(" * 200_000):
        P.candidates(text, P.base_spans(text))


def restated(edges, rounds=P.ROUNDS):
    """The scoring over sets of (instance, kind, may_be, pattern)."""
    members = defaultdict(set)
    for instance, kind, may, pattern in edges:
        members[pattern].add((instance, kind, may))
    accepted = {}
    for _ in range(rounds):
        good = {}
        for pattern, own in members.items():
            for k in range(4):
                taken = {i for i, kind, _ in own if kind == -1 and accepted.get(i, (None,))[0] == k}
                positive = sum(kind == k for _, kind, _ in own) + sum(accepted[i][1] for i in taken)
                weight = sum(P.UNKNOWN if kind == -1 and m >> k & 1 and i not in taken else 1 for i, kind, m in own)
                score = positive / (weight + P.SMOOTHING)
                if positive >= P.MIN_SUPPORT and score >= P.MIN_PATTERN:
                    good[pattern, k] = score
        now = {}
        for instance, may in {(i, m) for i, kind, m, _ in edges if kind == -1 and m}:
            best = None
            for k in range(4):
                if may >> k & 1:
                    doubt = math.prod(1 - good[p, k] for i, kind, _, p in edges if i == instance and kind == -1 and (p, k) in good)
                    if 1 - doubt >= P.ACCEPT and (best is None or 1 - doubt > best[1] + 1e-9):
                        best = (k, 1 - doubt)
            if best:
                now[instance] = best
        if len(now) == len(accepted):
            accepted = now
            break
        accepted = now
    return accepted


@pytest.mark.parametrize("seed", range(3))
def test_scores_equal_a_restatement(spark, seed):
    rng = random.Random(seed)
    edges = set()
    for n in range(160):
        kind = rng.choice([-1, 0, 0, 3, 3])
        may = rng.choice([0, 1, 8, 9, 12]) if kind == -1 else 0
        home = kind if kind >= 0 else rng.choice([0, 3])
        for _ in range(2):
            pattern = f"p{home}-{rng.randrange(6)}" if rng.random() < 0.93 else f"q{rng.randrange(4)}"
            edges.add((f"x{n}", kind, may, pattern))
    got = P.scored(spark.createDataFrame(sorted(edges), "instance string, kind int, may_be int, pattern string")).collect()
    want = restated(edges)
    assert {r["instance"]: r["kind"] for r in got} == {i: k for i, (k, _) in want.items()} and want
    assert all(abs(r["confidence"] - want[r["instance"]][1]) < 1e-4 for r in got)


def corpus():
    rng = random.Random(4)
    number = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10_000):04d}"
    rows = [f"Please call me on {number()} after lunch, room {n}." for n in range(20)]
    rows += [f"Mail to: user{n}@mail.example.com today" for n in range(20)]
    rows += [f"The order number 55501{n:02d} left the house" for n in range(20)]
    return rows


FOUND = ["Please call me on 555-0142 after lunch, room 9.", "Please call me on (555) 555 0143 after lunch!", "é mail to: root@localhost today"]
CLEAN = ["We sold 5550142000 units of it", "order number 5550190 left the house", "call me on Tuesday after lunch", "version 3.2 of 1999-12-31", "mail to: nobody today", "", None, " \n"]


def test_patterns_find_what_the_expressions_do_not(spark):
    rows = corpus() + FOUND + CLEAN + [FOUND[0]]
    docs = spark.createDataFrame([(n if n % 7 else None, t, "x") for n, t in enumerate(rows)], "doc_id long, text string, _base string")
    out, base, spans = P.with_private(docs)
    assert out.columns[:3] == docs.columns
    got = {}
    for r in out.select("text", P.spelled(out[base]).alias("b"), P.spelled(out[spans]).alias("s"), P.masked(out["text"], out[spans]).alias("m")).collect():
        assert r["b"] == ",".join(f"{PLAIN[k][0]}:{s}:{e}" for k, s, e in plain(r["text"] or ""))
        got[r["text"]] = (r["s"], r["m"])
    assert got[FOUND[0]] == ("phone:18:26", "Please call me on [phone] after lunch, room 9.")
    assert got[FOUND[1]] == ("phone:18:32", "Please call me on [phone] after lunch!")
    assert got[FOUND[2]] == ("email:11:25", "é mail to: [email] today")
    assert all(got[t][0] == "" for t in CLEAN)
    assert out.count() == len(rows)


def test_empty_table(spark):
    out, _, _ = P.with_private(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query_holds_the_base(spark):
    rows = {r["doc_id"]: r for r in op13_private_data(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want, r = plain(d.text or ""), rows[d.doc_id]
        named = [f"{PLAIN[k][0]}:{s}:{e}" for k, s, e in want]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x == k for x, _, _ in want) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r["spans"].split(",")) or not named
