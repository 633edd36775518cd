"""BPE encoding and decoding with a transducer lexicon.

The most frequent pre-tokens of the whole corpus (counted by Spark, partial
counts per task) and their ids are compiled on the driver into a minimal
acyclic transducer of at most ``LEXICON_WORDS`` words. The file goes to the
executors with ``addFile`` and is mapped into memory there. Words that it does
not hold are merged by the tokenizer itself, so the ids are always those of the
library; the lexicon changes the speed only. No text is shuffled by encoding.

``decoded(encoded(...))`` holds two Python workers a task at a time, and hands
the texts back from the first; ``encoded_and_decoded`` does both in one.

Defined results: a null text is the empty text and has no ids; a text that
holds the string of an added token gets that token's id, as by default in the
library; repeated rows are encoded alike. Added columns that clash with those of
the input get a trailing underscore.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm.common import free_name, map_texts, pieces, ref, ship_package, staged
from rinkspark.llm.lexicon import Lexicon, compile_words, save
from rinkspark.llm.text_arrays import ragged
from rinkspark.llm.word_pieces import WORD_PATTERN, Memo, cutter, library_encoder, load

#: Words compiled into the lexicon.
LEXICON_WORDS = 50_000
#: Distinct words that a counting task holds before it hands on its counts.
COUNT_WORDS = 150_000


def word_counts(docs: DataFrame, text_col: str, tokenizer_json: str) -> DataFrame:
    """Rows (word, n): how often each pre-token occurs in all texts."""
    ship_package(docs.sparkSession)
    source = docs.select(ref(docs, text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        cut = cutter(load(shared.value), WORD_PATTERN, lower=True)
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for whole in batches:
            for batch in pieces(whole, 0):
                for text in batch.column(0).to_pylist():
                    counts.update(cut(text or "") or ())
                if len(counts) > COUNT_WORDS:
                    yield out()
        yield out()

    return source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str, tokenizer_json: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, ``size`` at most, ship the file to the
    executors and return its name there.

    Words are taken down to the least count of which no more than ``size``
    words remain, found from the numbers of words per eighth of a power of two
    of the count: what reaches the driver is bounded, however many tasks."""
    counts = staged(word_counts(docs, text_col, tokenizer_json), "word-counts")
    grade = F.floor(F.log2("n") * 8)
    taken, least = 0, None
    for g, n in sorted(counts.groupBy(grade.alias("g")).count().collect(), reverse=True):
        taken += n
        if taken > size:
            break
        least = g
    top = [] if least is None else sorted(r[0] for r in counts.filter(grade >= least).select("word").collect())
    flat, sizes = library_encoder(load(tokenizer_json))(top)
    ids = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if top else []
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="rinkspark-lexicon-"), name)
    save(compile_words([w.encode() for w in top], ids), path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def lexicon_encoder(tok, lexicon: Lexicon) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of words from the transducer, the rest merged by the tokenizer."""
    library = library_encoder(tok)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = lexicon.ranks([w.encode() for w in words])
        unseen = np.flatnonzero(rows < 0)
        ids, sizes = library([words[i] for i in unseen.tolist()])
        rows[unseen] = len(lexicon) + np.arange(len(unseen))
        flat = np.concatenate([lexicon.ids, ids])
        begins = np.concatenate([lexicon.id_begins, len(lexicon.ids) + np.cumsum(sizes)])
        return ragged(flat, begins, rows), begins[rows + 1] - begins[rows]

    return encode


def _coded(docs: DataFrame, tokenizer_json: str, text_col: str, keep: Sequence[str] | None, back: bool) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``ids`` and, if ``back``, the
    text ``decoded`` from the ids."""
    name = build_lexicon(docs, text_col, tokenizer_json)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kept = docs if keep is None else docs.select(*[ref(docs, c) for c in keep])
    added = [T.StructField(free_name(kept, "ids"), T.BinaryType()), T.StructField(free_name(kept, "decoded"), T.StringType())]

    def make() -> Callable[[pa.Array], Sequence[pa.Array]]:
        tok = load(shared.value)
        memo = Memo(tok, cutter(tok, WORD_PATTERN, lower=True), lexicon_encoder(tok, Lexicon(SparkFiles.get(name))))
        decode = decoder(tok if tok.decoder else token_table(tok)) if back else None

        def run(texts: pa.Array) -> Sequence[pa.Array]:
            ids, begins = memo.encode(texts.to_pylist())
            raw, at = ids.astype("<u4").tobytes(), begins * 4
            cuts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            out = [pa.array(cuts, pa.binary())]
            if decode:
                out.append(pa.array([decode(np.frombuffer(b, "<u4").tolist()) for b in cuts], pa.string()))
            return out

        return run

    return map_texts(docs, text_col, make, T.StructType(added if back else added[:1]), keep)


def encoded(docs: DataFrame, tokenizer_json: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the ids as little-endian 32-bit integers."""
    return _coded(docs, tokenizer_json, text_col, None, back=False)


def encoded_and_decoded(docs: DataFrame, tokenizer_json: str, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``ids`` as ``encoded`` and ``decoded`` as
    ``decoded`` give them."""
    return _coded(docs, tokenizer_json, text_col, keep, back=True)


def decoded(rows: DataFrame, tokenizer_json: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the ids' text as the library's
    ``decode(ids, skip_special_tokens=False)``. Null ids give the empty text."""
    ship_package(rows.sparkSession)
    added, tok = free_name(rows, "decoded"), load(tokenizer_json)
    # Without a decoder in the file, the table of tokens is all a worker needs.
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer_json if tok.decoder else token_table(tok))
    schema = T.StructType([*rows.schema.fields, T.StructField(added, T.StringType())])
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        source = shared.value
        decode = decoder(load(source) if isinstance(source, str) else source)
        for whole in batches:
            for batch in pieces(whole, at):
                texts = [decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def token_table(tok) -> list[str]:
    """The token of each id; ids without one have the empty string."""
    size = max(tok.get_vocab(True).values(), default=-1) + 1
    return [tok.id_to_token(i) or "" for i in range(size)]


def decoder(source) -> Callable[[list[int]], str]:
    """Ids -> text, from a tokenizer or, for one that names no decoder (its
    tokens are joined by spaces), from its token table."""
    if not isinstance(source, list):
        return lambda ids: source.decode(ids, skip_special_tokens=False)
    token = source.__getitem__
    return lambda ids: " ".join(map(token, ids))
