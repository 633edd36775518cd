"""Phrase mining against a brute-force count."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rinkspark.llm import phrase_mining as M

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words, min_count, top, share=100):
    f, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    c = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = {}
    for (lang, w), a in c.items():
        if any(x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= share * a for (x, v), b in c.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, n, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for n, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def rows(seed):
    rng = random.Random(seed)
    vocab = [*"abcdefgh", "É", "ß", "New", "york", "%"]
    out = [("en", " ".join(rng.choices(vocab, k=rng.randrange(1, 60))).replace(" f ", ". ").replace(" g ", "\n")) for _ in range(80)]
    out += [("en", "new york CITY hall is here, " * 6), ("en", "the " * 50), (None, "a b a b a b"), ("und", "a b a b"), ("fr", None), ("fr", ""), (None, "a;b a\x0bb\tc")]
    return out + out[:3]


@pytest.mark.parametrize("shard_words", [40, 1 << 19])
@pytest.mark.parametrize(("max_words", "min_count", "top", "share"), [(5, 4, 2000, 100), (3, 3, 5, 60)])
def test_equal_to_brute_force(spark, monkeypatch, shard_words, max_words, min_count, top, share):
    monkeypatch.setattr(M, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(M, "PART_WORDS", 200 * shard_words)
    data = rows(max_words)
    docs = spark.createDataFrame(data, "lang string, text string").selectExpr("'x' AS phrase", "lang", "text", "1 AS shard").repartition(3)
    got = sorted(tuple(r) for r in M.collocations(docs, max_words=max_words, min_count=min_count, top=top, share=share).collect())
    assert got == brute(data, max_words, min_count, top, share) and got


def test_empty_and_blank(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert M.collocations(empty).collect() == []
    blank = spark.createDataFrame([("en", " . \n"), ("en", None)], "lang string, text string")
    assert M.collocations(blank, min_count=1).collect() == []


def test_index_finds_every_phrase():
    rng = np.random.default_rng(5)
    seq = rng.integers(0, 5, 400)
    seq[0] = seq[-1] = 0
    index = M.FmIndex(M.transform(seq), M.transform(seq[::-1]), 4)
    nodes = index.roots()
    for depth in range(1, 6):
        want = Counter(tuple(seq[i : i + depth].tolist()) for i in range(len(seq) - depth + 1) if (seq[i : i + depth] > 0).all())
        assert Counter({tuple(int(x) for x in p): int(n) for *p, n in zip(*index.spelled(nodes, depth), nodes[:, 1], strict=True)}) == want
        nodes = index.extended(nodes)


def test_tokens_of_texts_without_gaps():
    words, opens = M.tokens(pa.array(["ab", "", "cd e", ".f", "g"]))
    assert words.to_pylist() == ["ab", "cd", "e", "f", "g"] and opens.tolist() == [True, True, False, True, True]


def test_products_past_64_bits(spark):
    phrases = spark.createDataFrame([("en", 1, "a", 3 * 10**9), ("en", 1, "b", 3 * 10**9), ("en", 2, "a b", 2 * 10**9 + 7)], "lang string, words int, phrase string, a long")
    totals = spark.createDataFrame([("en", 10**14 + 3)], "lang string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(M, "frequent_phrases", lambda *a: (phrases, totals))
        (row,) = M.collocations(phrases).collect()
    assert row["score"] == 1000 * (2 * 10**9 + 7) * (10**14 + 3) // (9 * 10**18)
