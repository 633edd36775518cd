"""Quality rules: brute force on edge rows, order of the cascade."""

import re

import pytest
from pyspark.sql import functions as F

from rinkspark.llm.quality_rules import BASE_RULES, RULES, Rule, judged, keep_good, order_rules, quality_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    GOOD,
    GOOD,
    "a b c a b c a b c " * 20,
    "x y " * 60,
    "\n".join(["same line here"] * 30 + [GOOD]),
    "&&& ### " * 40 + GOOD,
    GOOD.upper(),
    "中文 \U0001f600 " * 40,
    " ".join(f"w{i % 4001}" for i in range(20000)),
]


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, rep = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            rep.update(i + k for i in at for k in range(3))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars, sym, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(rep) > 50 * n
    bad = sym * 10 > n * 3 or dup * 10 > len(lines) * 4 or len(re.findall("[A-Z]", t)) * 2 > chars or chars < 2 * n or chars > 20 * n
    return n, chars, sym, dup, len(rep), failed, not failed and not bad


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that the operator uses itself.
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, _words string, rejected_by int")


def test_report_equals_brute_force(docs):
    got = {r[0]: tuple(r)[1:] for r in quality_report(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_kept_rows_keep_their_columns(docs):
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if brute(t)[-1]}


def test_order_changes_no_verdict(docs):
    a = {r.doc_id for r in keep_good(docs, rules=RULES).collect()}
    b = {r.doc_id for r in keep_good(docs, rules=RULES[::-1]).collect()}
    assert a == b


def test_cheap_and_selective_rules_come_first(spark):
    docs = spark.createDataFrame([(i, GOOD if i % 10 else "few") for i in range(100)], "doc_id long, text string")
    never = Rule("never", lambda t, w: F.lit(False))
    often = Rule("often", lambda t, w: F.size(w) < 50)
    assert [r.name for r in order_rules(docs, "text", [never, often])] == ["often", "never"]


def test_the_order_is_the_same_in_ten_runs(spark):
    texts = [GOOD, "few", "# " * 90, "A" * 30 + " " + GOOD.upper(), "x y " * 60, None, "z" * (1 << 17)]
    docs = spark.createDataFrame([(i, texts[i % 7]) for i in range(210)], "doc_id long, text string").repartition(6, "doc_id")
    orders = {tuple(r.name for r in order_rules(docs, "text", RULES)) for _ in range(10)}
    assert len(orders) == 1 and orders.pop()[0] == "few_words"


def test_first_rejecting_rule_is_named(docs):
    rows = {r.doc_id: r["rejected_by_"] for r in judged(docs, rules=BASE_RULES).collect()}
    assert rows[0] == "few_words" and rows[4] is None and rows[6] == "repeated_words"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_report(empty).count() == 0 and keep_good(empty).count() == 0
