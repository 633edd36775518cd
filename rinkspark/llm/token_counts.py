"""Token counts by a two-tier lookup on the map side.

Tier 1 is a compact hash table (open addressing in flat arrays) from frequent
pre-tokens to their number of tokens, built on the driver and broadcast. It
holds the tokenizer's own vocabulary, as far as its entries are pre-tokens, and
the most frequent pre-tokens of a sample; its size is bounded by
``TABLE_WORDS`` plus the vocabulary. Tier 2 is a cache in each worker: a word
seen first is looked up in the table, and if it misses, encoded by the
library; its length is kept. Neither pre-tokens nor texts are shuffled; the
sample (``SAMPLE_DOCS`` rows) fills the table only and cannot change a count.

Defined results: a null text is empty, with 0 bytes and 0 tokens; strings of
added tokens inside a text count as the library takes them by default. Repeated
rows are counted each. Clashing added names get a trailing underscore.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm.common import free_name, map_texts, ref, spread_sample
from rinkspark.llm.text_arrays import span_hashes
from rinkspark.llm.word_pieces import BYTE_PATTERN, CACHE_WORDS, WordCache, cutter, library_encoder, load

SAMPLE_DOCS = 500
TABLE_WORDS = 50_000


def _hashes(words: Sequence[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(words) else ends
    return span_hashes(np.frombuffer(b"".join(words), np.uint8), begins, ends)


@dataclass
class LengthTable:
    """Pre-token -> number of tokens, as flat arrays with linear probing."""

    slots: np.ndarray  # entry + 1 of each slot, 0 if free
    hashes: np.ndarray  # per entry
    lengths: np.ndarray
    text: bytes  # the entries' bytes, to confirm a hit
    begins: np.ndarray

    @staticmethod
    def build(words: Sequence[bytes], lengths: Sequence[int]) -> LengthTable:
        size = 1 << max(4, (2 * len(words)).bit_length())
        slots, hashes = np.zeros(size, np.int32), _hashes(words)
        place = (hashes & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(len(words))
        while len(left):  # each round, one entry of every wanted free slot moves in
            free = left[slots[place[left]] == 0]
            _, first = np.unique(place[free], return_index=True)
            slots[place[free[first]]] = free[first] + 1
            left = left[slots[place[left]] != left + 1]
            place[left] = (place[left] + 1) & (size - 1)
        begins = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return LengthTable(slots, hashes, np.array(lengths, np.int64), b"".join(words), begins)

    def lookup(self, words: Sequence[bytes]) -> np.ndarray:
        """Lengths of the words, -1 for those not in the table."""
        out = np.full(len(words), -1, np.int64)
        if not len(words):
            return out
        h = _hashes(words)
        mask = len(self.slots) - 1
        place = (h & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(words))
        while len(left):
            entry = self.slots[place[left]].astype(np.int64) - 1
            left, entry = left[entry >= 0], entry[entry >= 0]
            for i, e in zip(left[self.hashes[entry] == h[left]].tolist(), entry[self.hashes[entry] == h[left]].tolist(), strict=True):
                if self.text[self.begins[e] : self.begins[e + 1]] == words[i]:
                    out[i] = self.lengths[e]
            left = left[out[left] < 0]
            place[left] = (place[left] + 1) & mask
        return out


class Lengths(WordCache):
    """Tier 2: the worker's cache over the table and the library."""

    def __init__(self, tok, table: LengthTable, limit: int = CACHE_WORDS):
        super().__init__(cutter(tok, BYTE_PATTERN, lower=False), limit)
        self.tok, self.table, self.library = tok, table, library_encoder(tok)
        self.known = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        found = self.table.lookup([w.encode() for w in words])
        misses = np.flatnonzero(found < 0)
        found[misses] = self.library([words[i] for i in misses.tolist()])[1]
        self.known = np.concatenate([self.known, found])

    def keep(self, rows: np.ndarray) -> None:
        self.known = self.known[rows]

    def count(self, texts: Sequence[str]) -> np.ndarray:
        codes, first, whole = self.numbered(texts)
        out = np.diff(np.concatenate([[0], np.cumsum(self.known[codes])])[first])
        for i in whole:
            out[i] = len(self.tok.encode(texts[i], add_special_tokens=False).ids)
        return out


def build_table(docs: DataFrame, text_col: str, tokenizer_json: str, sample_docs: int = SAMPLE_DOCS, size: int = TABLE_WORDS) -> LengthTable:
    """The frequent pre-tokens of ``sample_docs`` rows from all over the table,
    and the vocabulary's entries that are pre-tokens. (Counting the pre-tokens
    of all rows would shuffle them; a word that the sample lacks is looked up
    in tier 2.)"""
    tok = load(tokenizer_json)
    cut, counts = cutter(tok, BYTE_PATTERN, lower=False), Counter()
    for text in spread_sample(docs, text_col, sample_docs):
        counts.update(cut(text) or ())
    words = {w for w, _ in counts.most_common(size)}
    words.update(w for w in map(tok.decode, ([i] for i in range(tok.get_vocab_size(False)))) if w and cut(w) == [w])
    ordered = sorted(words)
    return LengthTable.build([w.encode() for w in ordered], library_encoder(tok)(ordered)[1])


def with_token_counts(docs: DataFrame, tokenizer_json: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    table = build_table(docs, text_col, tokenizer_json)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, table))

    def make() -> Callable[[pa.Array], Sequence[pa.Array]]:
        lengths = Lengths(load(shared.value[0]), shared.value[1])
        return lambda texts: [pa.array(lengths.count(texts.to_pylist()))]

    out = docs.withColumn(free_name(docs, "n_bytes"), F.coalesce(F.octet_length(ref(docs, text_col)), F.lit(0)).cast("long"))
    return map_texts(out, text_col, make, T.StructType([T.StructField(free_name(out, "n_tokens"), T.LongType())]))
