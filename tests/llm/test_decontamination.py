"""Decontamination: suffix-array search against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rinkspark.llm.decontamination import WIDTH, decontaminated, matched_items, with_matches, words_hit

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


rng = random.Random(7)
VOCAB = ["the", "of", "é", "x1", "中文", "and", "to"]
ITEMS = [(i, " ".join(rng.choices(VOCAB, k=k))) for i, k in enumerate([25, 12, 10, 9, 3, 1, 0, 40])]
ITEMS += [(8, ITEMS[0][1].upper() + "!"), (9, None), (None, "the of and"), (10, " ".join(["the"] * 15)), (0, "a second text of item zero that has more than ten words in it")]


def piece(i, a, b):
    return " ".join(ITEMS[i][1].split()[a:b])


DOCS = [
    None,
    "",
    "...",
    ITEMS[0][1],
    "zzz " + ITEMS[0][1].replace(" ", ", ").upper() + " zzz",
    "q " + piece(0, 3, 12),
    "q " + piece(0, 3, 13) + " q " + piece(0, 3, 13),
    piece(7, 0, 20) + " " + piece(7, 10, 40),
    " ".join(["the"] * 40),
    " ".join(rng.choices(VOCAB, k=3000)),
    " ".join(rng.choices(VOCAB, k=3000)) + " " + ITEMS[1][1],
    "unrelated " * 30000 + ITEMS[7][1],
    "unrelated text here",
    "x1x é" + "\0" + "the",
]


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for name, t in items:
        iw = words(t)
        if name is None or not iw:
            continue
        k = min(WIDTH, len(iw))
        wins = {tuple(iw[j : j + k]) for j in range(len(iw) - k + 1)}
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in wins:
                hit.update(range(p, p + k))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(DOCS)] + [(3, DOCS[3], 2, "y")], "doc_id long, text string, n_words int, MATCHES string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, extra int")


@pytest.mark.parametrize("block_words", [1_000_000, 8])
def test_hits_equal_brute_force(docs, benchmark, block_words):
    out, n, m = with_matches(docs, benchmark, block_words=block_words)
    rows = out.select("doc_id", n, words_hit(F.col(m)), matched_items(F.col(m))).collect()
    assert len(rows) == len(DOCS) + 1
    for i, n_words, hit, items in rows:
        assert (n_words, hit, items) == brute(DOCS[i], ITEMS), i


def test_matches_are_longest_and_verbatim(docs, benchmark):
    out, _, m = with_matches(docs, benchmark)
    texts = {}
    for i, t in ITEMS:
        texts.setdefault(str(i), []).append(words(t))
    for r in out.filter(F.col("doc_id") != 9).collect():
        w = words(r.text)
        for x in r[m]:
            run = w[x["doc_word"] : x["doc_word"] + x["n_words"]]
            assert any(run == t[x["item_word"] : x["item_word"] + x["n_words"]] for t in texts[x["item_id"]])
    seven = [tuple(x) for r in out.filter("doc_id = 7").collect() for x in r[m] if x["item_id"] == "7"]
    assert ("7", 0, 0, 20) in seven and ("7", 20, 10, 30) in seven


def test_clean_documents_stay_with_their_columns(docs, benchmark):
    kept = decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(DOCS) if not brute(t, ITEMS)[1]}


def test_empty_tables(docs, benchmark):
    none = benchmark.filter("false")
    out, n, m = with_matches(docs, none)
    assert out.filter(F.size(m) > 0).count() == 0
    assert decontaminated(docs.filter("false"), benchmark).count() == 0


def test_blocks_are_searched_in_one_pass(spark):
    """However many blocks the benchmark has, the plan holds one Python stage."""
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(30)]
    docs = spark.createDataFrame([(k, f"a b {t} c") for k, (_, t) in enumerate(items)], "doc_id long, text string")
    out, _, m = with_matches(docs, spark.createDataFrame(items, "item_id string, text string"), block_words=40)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r["doc_id"], r[m][0]["item_id"], len(r[m])) for r in out.collect()} == {(k, f"i{k}", 1) for k in range(30)}
