"""Near-dedup and substring dedup against brute force, and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rinkspark.llm.components import components
from rinkspark.llm.near_dedup import LONG_FROM, SHORT_TO, bucket_keys, labelled, near_classes, one_of_each, shingles, similarity
from rinkspark.llm.substring_dedup import MIN_WORDS, chunk_begins, deduplicated, gear, with_repeats
from rinkspark.llm.text_arrays import utf8
from rinkspark.llm.text_arrays import words as word_arrays

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def labels(w):
    n, seen, out = min(5, len(w)), Counter(), []
    for i in range(len(w) - n + 1 if w else 0):
        s = tuple(w[i : i + n])
        seen[s] += 1
        out.append((s, seen[s]))
    return out


def ordered(a, b):
    """Share of the longest common subsequence in the union, by plain DP."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1]) if a or b else 0.0


rng = random.Random(11)
VOCAB = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choices(VOCAB, k=n))


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def near_rows():
    rows, base, line = [], prose(200), "this fixed line stands in very many short documents here"
    rows += [base, base.upper() + "!!", base]
    rows += [edited(base, k) for k in (1, 2, 3, 5, 8, 30) for _ in range(4)]
    rows += [prose(150) + " " + base, " ".join(base.split()[100:] + base.split()[:100])]
    rows += [None, "", "!!!", "!!!", "?", "one", "One.", "one two"]
    short = prose(14).split()
    rows += [" ".join(short), " ".join(short[1:]), " ".join(short[:-1]), " ".join([*short, "x"]), " ".join([*short[:7], "x", *short[8:]])]
    edge = prose(26)
    rows += [edge, edge + " tail", "head " + edge, edge + " " + prose(3)]
    rows += [f"{line} {prose(12)}" for _ in range(30)]
    rows += ["same " * 300, "same " * 310, "same " * 500]
    chain = prose(120).split()
    for k in range(6):  # each like the next, the ends not alike
        rows.append(" ".join(chain[6 * k : 6 * k + 90]))
    return rows


def classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seqs = [labels(words(t)) for t in rows]
    for i, a in enumerate(seqs):
        for j in range(i):
            same = a and seqs[j] and (a == seqs[j] or 1.25 * min(len(a), len(seqs[j])) >= max(len(a), len(seqs[j])) and ordered(a, seqs[j]) >= 0.8)
            if same or not a and rows[i] and rows[i] == rows[j]:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(rows))}


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)] + [(0, rows[0], "y", 2), (None, rows[0], "z", 3)], "doc_id long, text string, id string, _kept int")
    got = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    want = classes(rows)
    assert got == want
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.filter("doc_id is null").count() == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_classes(none).count() == 0 and one_of_each(none).count() == 0 and deduplicated(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 5)), max_size=3))
def test_banded_alignment_equals_dynamic_programming(a, edits):
    b = list(a)
    for at, x in edits:
        b.insert(at % (len(b) + 1), x)
    la, lb = (labelled(shingles(np.array(x, np.uint64) + np.uint64(1))) for x in (a, b))
    true = ordered(labels([str(x) for x in a]), labels([str(x) for x in b]))
    got = similarity(la, lb)
    assert got == pytest.approx(true) if true >= 0.8 else got == 0
    if true >= 0.8 and max(len(la), len(lb)) <= SHORT_TO:
        assert set(bucket_keys(la).tolist()) & set(bucket_keys(lb).tolist())


SPAM = "buy cheap pills online now m0 m1 m2 m3 m4 m5 m6 buy cheap pills online now z0 z1 z2 z3 z4 z5"


def test_short_texts_that_repeat_words(spark):
    """Trimmed or edited where a run of words repeats: labels are renumbered."""
    again = "a1 a2 a3 a4 a5 a6 no no no no no b1 b2 b3 b4 b5 b6"
    rows = [SPAM, SPAM.split(" ", 1)[1], again, again.replace("no ", "", 1), again.replace("no ", "no no no ", 1), prose(20)]
    want = classes(rows)
    assert want[1] == 0 and want[3] == 2
    assert {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()} == want


def test_short_pairs_at_the_bound_share_a_key():
    r, met = random.Random(5), 0
    for _ in range(3000):
        a = [r.randrange(r.choice((2, 4, 40))) for _ in range(r.randrange(1, 29))]
        b = list(a)
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice(([], [r.randrange(5)], b[max(0, k - 5) : k]))
        la, lb = (labelled(shingles(np.array(x, np.uint64) + np.uint64(1))) for x in (a, b))
        if 0 < max(len(la), len(lb)) <= SHORT_TO and len(lb) and ordered(la.tolist(), lb.tolist()) >= 0.8:
            met += 1
            assert set(bucket_keys(la).tolist()) & set(bucket_keys(lb).tolist()), (a, b)
    assert met > 300


def test_sketches_meet_at_the_bound():
    met = 0
    for k in range(200):
        r = np.random.default_rng(k)
        base = r.integers(0, 2**63, 180, dtype=np.uint64)
        other = np.concatenate([base[:160], r.integers(0, 2**63, 20, dtype=np.uint64)])  # 160 of 200
        met += bool(set(bucket_keys(base).tolist()) & set(bucket_keys(other).tolist()))
    assert met >= 199
    assert len(bucket_keys(np.arange(LONG_FROM - 1, dtype=np.uint64))) <= 21


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (199, 198)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 198: 198, 199: 198, 200: 198}


def test_very_long_texts_and_repeated_ids(spark):
    long = prose(20_000)
    near = edited(long, 20)
    rows = [(1, long, "x"), (2, near, "x"), (3, prose(15_000), "x"), (1, "a shorter text of the same id", "y"), (1, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    classes = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3}
    kept = sorted((r.doc_id, r.text, r.note) for r in one_of_each(docs).collect())
    assert kept == [(1, max(long, "a shorter text of the same id"), "z" if long > "a shorter text of the same id" else "y"), (3, rows[2][1], "x")]


def test_recall_against_all_pairs(spark):
    """Classes of edited copies equal those of all pairs at 0.8."""
    originals = [prose(n) for n in (12, 30, 45, 80, 150, 300)]
    rows = [t for t in originals for _ in range(1)] + [edited(t, k) for t in originals for k in (1, 1, 2, 4, 8)]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    parent, own = list(range(len(rows))), [labels(words(t)) for t in rows]

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if ordered(own[i], own[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(rows))}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(rows) and len(set(want.values())) < len(rows)


# Substring dedup.


def substring_rows():
    p, q, r = prose(60), prose(51), prose(49)
    rows = [None, "", "tiny", f"{prose(40)} {p} {prose(30)}", f"{prose(33)}. {p.upper()}. {prose(30)}", p, f"{prose(5)}\n\n{p}\n{prose(40)}"]
    rows += [f"{prose(20)} {q} {prose(20)}", f"{q} {prose(70)}", f"{prose(90)} {q}", f"{prose(30)} {r} {prose(30)}", f"{prose(25)} {r} {prose(25)}"]
    rows += [f"{p} {prose(10)} {p}", prose(500), prose(500), f"é中 {prose(30)} ({p}), {prose(20)} {q}!"]
    long = prose(9000)
    return [*rows, long, f"{prose(10)} {long}"]


def brute_removed(rows):
    first, hit = {}, {}
    for i, t in enumerate(rows):
        w = words(t)
        for k in range(len(w) - MIN_WORDS + 1):
            if first.setdefault(tuple(w[k : k + MIN_WORDS]), i) != i:
                hit.setdefault(i, set()).update(range(k, k + MIN_WORDS))
    return hit


def test_repeated_passages_equal_brute_force(spark):
    rows = substring_rows()
    docs = spark.createDataFrame([(i, t, len(t or ""), "x", 1) for i, t in enumerate(rows)] + [(None, rows[3], 1, "x", 1), (4, "another text", 12, "x", 1)], "doc_id long, text string, n_chars long, _spans string, id int")
    out = deduplicated(docs, length_col="n_chars")
    assert out.columns == docs.columns and out.count() == len(rows) + 2
    hit = brute_removed(rows)
    assert len(hit) >= 8
    for r in out.collect():
        if r.doc_id is None:
            assert r.text == rows[3]
        elif r.text != "another text":
            left = [w for k, w in enumerate(words(rows[r.doc_id])) if k not in hit.get(r.doc_id, ())]
            assert words(r.text) == left, r.doc_id
            assert r.n_chars == len(r.text or "")
            if r.doc_id not in hit:
                assert r.text == rows[r.doc_id]


def test_near_copy_before_two_full_holders(spark):
    """The first holder of a passage's chunks has no run of 50 words of it."""
    rows = []
    for size in (50, 52, 55, 60) * 4:
        p = prose(size).split()
        near = [*p[:7], "edited", *p[8:]] if len(rows) % 2 else p[:48]
        rows += [f"{prose(30)} {' '.join(near)} {prose(30)}", f"{prose(30)} {' '.join(p)} {prose(30)}", f"{prose(20)} {' '.join(p)} {prose(40)}"]
    out = deduplicated(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    hit = brute_removed(rows)
    assert len(hit) >= 16
    for r in out.collect():
        assert words(r.text) == [w for k, w in enumerate(words(rows[r.doc_id])) if k not in hit.get(r.doc_id, ())], r.doc_id


def test_spans_name_an_earlier_holder(spark):
    rows = substring_rows()
    out, spans, _ = with_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    for r in out.filter(f"{spans} is not null").collect():
        for s in r[spans]:
            passage = " ".join(words(r.text.encode()[s["begin"] : s["end"]].decode()))
            assert s["holder"] < r.doc_id and passage in " ".join(words(rows[s["holder"]])) and s["n_words"] >= MIN_WORDS


def chunk_texts(text):
    low, starts, ends, _ = word_arrays(*utf8(pa.array([text])))
    w = words(text)
    b = chunk_begins(low, starts, ends)[0].tolist()
    return [tuple(w[x:y]) for x, y in zip(b, [*b[1:], len(w)], strict=True)] if b else []


def test_chunks_resist_insertions():
    text = prose(600)
    a, b = chunk_texts(text), chunk_texts("some words in front " + text)
    assert len(set(a) & set(b)) >= len(a) - 2
    assert sum(map(len, a)) == 600 and 60 <= len(a) <= 120
    w = text.split()
    c = chunk_texts(" ".join([*w[:300], "inserted", *w[300:]]))
    assert len(set(a) - set(c)) <= 4
    assert chunk_texts("") == [] and len(chunk_texts("a " * 500)) > 10


def test_gear_covers_sixteen_bytes():
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in ("x" * 40 + "0123456789abcdef", "y" * 40 + "0123456789abcdef"))
    ha, hb = gear(a), gear(b)
    assert ha[-1] == hb[-1] and ha[-2] != hb[-2]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base, passage = prose(300), prose(60)
    item = prose(30)
    rows = [base, base, edited(base, 2), f"{prose(200)} {passage}", f"{passage} {prose(200)}", f"{prose(100)} {item} {prose(100)}", "short", None, "a b " * 100, "### " * 100, *[prose(120) for _ in range(5)]]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = table, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == table.columns
        if name == "substring_dedup":
            text = {r.doc_id: r.text for r in docs.collect()}
            assert passage in text[3] and words(text[4]) == words(rows[4])[60:]
    assert ids == [set(range(6)) | set(range(10, 15)), {0, 3, 4, 5} | set(range(10, 15)), {0, 3, 4, 5} | set(range(10, 15)), {0, 3, 4} | set(range(10, 15)), {0, 3, 4} | set(range(10, 15))]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[-1]


