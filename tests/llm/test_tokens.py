"""Token files, BPE with the lexicon, and token counts against the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkspark.llm.bpe_codec import decoded, encoded
from rinkspark.llm.bpe_queries import op7_bpe_codec, tokenizer_file
from rinkspark.llm.lexicon import Lexicon, compile_words, save
from rinkspark.llm.token_counts import LengthTable, with_token_counts
from rinkspark.llm.token_queries import op5_token_store, op8_token_counts
from rinkspark.llm.token_store import Segment, pack, read_tokens, write_tokens
from rinkspark.llm.word_pieces import BYTE_PATTERN, SAFE, WORD_PATTERN, Memo, cutter, library_encoder, load

TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello, WORLD! it's  we'll I'M 'sx 123 ½",
    "Ünïcödé ﬁ ﬀ İstanbul Σίσυφος ΟΔΟΣ e\u0301 \u212b",
    "中文 テスト 한국어 \U0001f600\u200d\U0001f468 \x1c\x85\xa0x",
    "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
    "word " * 30000,
    "x" * 5000,
    "word " * 30000,
    " ".join(f"tok{i}" for i in range(3000)),
    "\0 \ufffd nul",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    rows = [((i * 7919) % 101 - 5, t, "x", 3) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), {i: t or "" for i, t, *_ in rows}


def library(name):
    return load(tokenizer_file(name))


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def test_op7_equals_the_library(spark, tables):
    path, texts = tables
    tok = library("word_bpe_49k.json")
    got = {r.doc_id: tuple(r)[1:] for r in op7_bpe_codec(spark, path).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t[:50]


def test_encoding_and_decoding_share_a_worker(spark, tables):
    import corpus_pipeline

    path, texts = tables
    tok = library("word_bpe_49k.json")
    docs = spark.read.parquet(path + "/documents.parquet").selectExpr("doc_id", "'en' as lang", "'s' as source", "text", "ids")
    out = corpus_pipeline.bpe(spark, docs, path)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
    for df in (out, op7_bpe_codec(spark, path)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = {r.doc_id: (r.lang, r.source, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()}
    assert got == {i: ("en", "s", len(ids), u32(ids), tok.decode(ids, skip_special_tokens=False)) for i, ids in want.items()}


def test_op5_equals_the_library(spark, tables):
    path, texts = tables
    tok, start = library("word_bpe_49k.json"), 0
    got = {r.doc_id: tuple(r)[1:] for r in op5_token_store(spark, path).collect()}
    for i in sorted(texts):
        ids = tok.encode(texts[i], add_special_tokens=False).ids + [1]
        assert got[i] == (start, len(ids), zlib.crc32(u32(ids)))
        start += len(ids)


def test_op8_equals_the_library(spark, tables):
    path, texts = tables
    tok = library("byte_bpe_50k.json")
    got = {r.doc_id: tuple(r)[1:] for r in op8_token_counts(spark, path).collect()}
    for i, t in texts.items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 1024), t[:50]


def test_columns_pass_through_and_empty_tables(spark, tables):
    docs = spark.read.parquet(tables[0] + "/documents.parquet")
    tok = tokenizer_file("word_bpe_49k.json")
    out = encoded(docs, tok)
    assert out.columns == [*docs.columns, "ids_"]
    assert decoded(out, tok, "ids_").columns == [*out.columns, "decoded"]
    assert with_token_counts(docs, tokenizer_file("byte_bpe_50k.json")).columns == [*docs.columns, "n_bytes", "n_tokens_"]
    none = docs.filter("false")
    assert encoded(none, tok).count() == 0
    assert with_token_counts(none, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_small_segments_keep_order_and_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame([(5, "b"), (5, "a"), (None, "null id"), (1, "one"), (5, "a")], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), tokenizer_file("word_bpe_49k.json"), 1, segment_tokens=2)
    tok = library("word_bpe_49k.json")
    rows = read_tokens(spark, str(tmp_path / "t")).orderBy("partition", "number", "row").collect()
    want = [(None, "null id"), (1, "one"), (5, "a"), (5, "a"), (5, "b")]
    assert [(r.doc_id, bytes(r.ids)) for r in rows] == [(i, u32(tok.encode(t, add_special_tokens=False).ids + [1])) for i, t in want]
    write_tokens(docs.filter("false"), str(tmp_path / "none"), tokenizer_file("word_bpe_49k.json"), 1)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("top", [1, 200, 40_000, 2**32 - 1])
def test_any_id_is_read_directly(top):
    rng = np.random.default_rng(top % 1000)
    ids = (rng.random(3000) ** 3 * top).astype(np.uint32)
    s = Segment(pack(ids, np.array([0, 10, 10, 3000]), [4, None, 6], 2, 3))
    assert (s.partition, s.number, s.n_tokens) == (2, 3, 3000)
    assert [s[i] for i in range(0, 3000, 37)] == ids[::37].tolist()
    for a, b in [(0, 3000), (511, 513), (512, 1025), (7, 7), (2999, 3000), (1, 2000)]:
        assert s.slice(a, b).tolist() == ids[a:b].tolist()


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 7))) for _ in range(800)} | {"running", "jumping", "run", "jump"})
    ids = [[i, 7 * i] for i in range(len(words))]
    order = list(range(len(words)))
    rng.shuffle(order)
    arrays = compile_words([words[i].encode() for i in order], [ids[i] for i in order])
    save(arrays, str(tmp_path / "lex"))
    lex = Lexicon(str(tmp_path / "lex"))
    ranks = lex.ranks([w.encode() for w in words] + [b"", b"zzz", b"runn", "é".encode()[:1]])
    assert [lex.ids_of(r).tolist() for r in ranks[: len(words)]] == ids
    assert [r >= 0 for r in ranks[len(words) :]] == [w in words for w in ("", "zzz", "runn", "no")]
    # Minimal: as many states as there are different sets of endings.
    raw = [w.encode() for w in words]
    endings = {}
    for w in raw:
        for k in range(len(w) + 1):
            endings.setdefault(w[:k], set()).add(w[k:])
    assert len(arrays["final"]) == len({frozenset(e) for e in endings.values()})
    assert compile_words([], [])["final"].tolist() == [0]


def test_length_table():
    rng = random.Random(5)
    words = list({bytes(rng.choices(b"abc \xc3", k=rng.randint(1, 6))) for _ in range(500)})
    table = LengthTable.build(words, range(len(words)))
    assert table.lookup([*words, b"", b"zz"]).tolist() == [*range(len(words)), -1, -1]
    assert LengthTable.build([], []).lookup([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("name,pattern,lower", [("word_bpe_49k.json", WORD_PATTERN, True), ("byte_bpe_50k.json", BYTE_PATTERN, False)])
def test_every_safe_character_is_cut_as_the_library_does(name, pattern, lower):
    tok = library(name)
    memo = Memo(tok, cutter(tok, pattern, lower), library_encoder(tok))
    texts = [a + c + b for c in SAFE for a in ("", "a", "1", ".", " ", "'") for b in ("", "a", "1", ".", " ", "'s")] + ["".join(SAFE)]
    ids, begins = memo.encode(texts)
    for i, t in enumerate(texts):
        assert ids[begins[i] : begins[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_sum_of_bytes_is_native(spark):
    df = spark.createDataFrame([("é",), (None,)], "text string")
    assert [r.n_bytes for r in with_token_counts(df, tokenizer_file("byte_bpe_50k.json")).orderBy(F.col("text").desc()).collect()] == [2, 0]
