"""Benchmark decontamination with suffix arrays over the training texts.

Each Arrow piece of the documents (at most 1 MB of text, or one longer text)
is a shard. A task turns the shard's words into ranks of the benchmark's
vocabulary and sorts a suffix array of the word positions at which a test
window can begin (those whose first words form the beginning of some window;
no other suffix can match). Every test suffix is binary-searched in it; the
run of equal suffixes is the set of locations. Locations on one diagonal
(document position minus item position) are joined to longest verbatim
matches. Documents are not shuffled, and nothing of them reaches the driver.

The benchmark goes out in blocks of about ``BLOCK_WORDS`` words, one file each,
prepared one at a time while the benchmark streams through the driver. Tasks
map the files into memory and search a shard block by block in one pass over
the documents, so neither the driver nor a task holds more than a block.

A window is ``width`` consecutive words of an item; an item of fewer words,
but not none, is one window. Words are compared by 64-bit hash and length.

Defined results: null and empty texts have no words and no hits; items without
words match nothing; items with equal windows are all reported; repeated
documents are judged each on their own; items without an id are ignored; a
repeated item_id is one item with several texts. Other columns pass through,
added names get a trailing underscore on a clash.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm.common import free_name, map_texts, ref
from rinkspark.llm.text_arrays import mixed, span_hashes, utf8, words

WIDTH = 10
#: Words of the benchmark held by a task at a time.
BLOCK_WORDS = 1_000_000
#: Leading words by which a suffix is chosen for the array.
LEAD = 3

MATCHES = "array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"


@dataclass
class Block:
    """Windows of one block of the benchmark, prepared for searching."""

    vocabulary: np.ndarray  # sorted word keys; rank = index + 1
    items: Sequence
    windows: np.ndarray  # distinct windows as sorted byte keys
    lengths: np.ndarray  # words of each window
    owner_begins: np.ndarray  # per window, its range in the two arrays below
    owner_item: np.ndarray
    owner_word: np.ndarray
    leads: list[tuple[int, np.ndarray]]  # (words, sorted hashes of leading words)


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each word of all texts, and each text's first word."""
    data, begins = utf8(texts)
    low, starts, ends, first = words(data, begins)
    return span_hashes(low, starts, ends), first


def _lead_hash(ranks: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mixed(h * np.uint64(0x100000001B3) + ranks[at + k].astype(np.uint64))
    return h


def _suffix_keys(ranks: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The next ``width`` ranks of each position as bytes that sort alike."""
    rows = ranks[at[:, None] + np.arange(width)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * width}").ravel()


def prepare(items: Sequence[tuple[str, str]], width: int = WIDTH) -> Block:
    """Prepare (item_id, text) pairs for searching."""
    names = [i for i, _ in items]
    keys, first = word_keys(pa.array([t for _, t in items], pa.string()))
    vocabulary = np.unique(keys)
    ranks = np.append(np.searchsorted(vocabulary, keys) + 1, np.zeros(width, np.int64)).astype(np.uint32)
    at, size, owner, word = [], [], [], []
    for i in range(len(names)):
        n = int(first[i + 1] - first[i])
        w = min(n, width)
        for j in range(n - w + 1 if n else 0):
            at.append(int(first[i]) + j), size.append(w), owner.append(i), word.append(j)
    at, size = np.array(at, np.int64), np.array(size, np.int64)
    rows = ranks[at[:, None] + np.arange(width)] * (np.arange(width) < size[:, None]) if len(at) else np.zeros((0, width), np.uint32)
    all_keys = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel()
    windows, which = np.unique(all_keys, return_inverse=True)
    order = np.argsort(which, kind="stable")
    lengths = np.zeros(len(windows), np.int64)
    lengths[which] = size
    leads = []
    for n in sorted({min(int(s), LEAD) for s in size}):
        chosen = at[np.minimum(size, LEAD) == n]
        leads.append((n, np.unique(_lead_hash(ranks, chosen, n))))
    return Block(vocabulary, names, windows, lengths, np.searchsorted(which[order], np.arange(len(windows) + 1)), np.array(owner, np.int64)[order], np.array(word, np.int64)[order], leads)


def locations(block: Block, keys: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of the block's windows in a shard: word positions and
    window numbers."""
    if not len(keys) or not len(block.windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.minimum(np.searchsorted(block.vocabulary, keys), len(block.vocabulary) - 1)
    known = np.where(block.vocabulary[found] == keys, found + 1, 0).astype(np.uint32)
    # A rank of 0 behind every text: no match runs into the next one.
    n_texts = len(first) - 1
    text_of = np.repeat(np.arange(n_texts), np.diff(first))
    ranks = np.zeros(len(keys) + n_texts + width, np.uint32)
    ranks[np.arange(len(keys)) + text_of] = known
    alive = np.flatnonzero(ranks[: len(ranks) - width])
    chosen = []
    for n, hashes in block.leads:
        at = alive
        for k in range(1, n):
            at = at[ranks[at + k] > 0]
        h = _lead_hash(ranks, at, n)
        chosen.append(at[hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h])
    at = np.unique(np.concatenate(chosen))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffixes = _suffix_keys(ranks, at, width)
    order = np.argsort(suffixes, kind="stable")
    suffixes, at = suffixes[order], at[order]
    low = np.searchsorted(suffixes, block.windows, "left")
    high = np.searchsorted(suffixes, block.windows, "right")
    for i in np.flatnonzero(block.lengths < width):  # a prefix of the suffix is asked for
        stem = block.windows[i].ljust(4 * width, b"\0")[: 4 * block.lengths[i]]
        high[i] = np.searchsorted(suffixes, np.array([stem.ljust(4 * width, b"\xff")], suffixes.dtype), "right")[0]
    counts = high - low
    window = np.repeat(np.arange(len(counts)), counts)
    row = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    slot = at[row]
    # Back from slots with separators to word positions.
    text = np.searchsorted(first[:-1] + np.arange(n_texts), slot, "right") - 1
    return slot - text, window


def longest(block: Block, at: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Longest verbatim matches from occurrences: rows (item, doc word, item
    word, words). ``at`` are positions within one document."""
    counts = block.owner_begins[window + 1] - block.owner_begins[window]
    row = np.repeat(block.owner_begins[window], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    doc, item, word, size = np.repeat(at, counts), block.owner_item[row], block.owner_word[row], np.repeat(block.lengths[window], counts)
    order = np.lexsort((doc, doc - word, item))
    doc, item, word, size = doc[order], item[order], word[order], size[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (item[1:] != item[:-1]) | (doc[1:] - word[1:] != doc[:-1] - word[:-1]) | (doc[1:] > doc[:-1] + 1)
    start = np.flatnonzero(opens)
    last = np.append(start[1:], len(doc)) - 1
    return np.stack([item[start], doc[start], word[start], doc[last] + size[last] - doc[start]], axis=1) if len(doc) else np.zeros((0, 4), np.int64)


_ARRAYS = ("vocabulary", "lengths", "owner_begins", "owner_item", "owner_word")


def save(block: Block, path: str, width: int) -> None:
    """Write a block so that :func:`opened` can map it: one row, a list per
    array."""

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = {c: one(pa.array(getattr(block, c))) for c in _ARRAYS}
    columns["items"] = one(pa.array(block.items, pa.string()))
    data = np.ascontiguousarray(block.windows)
    columns["windows"] = one(pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(data), [None, pa.py_buffer(data)]))
    columns["lead_words"] = one(pa.array([n for n, _ in block.leads], pa.int64()))
    columns["lead_sizes"] = one(pa.array([len(h) for _, h in block.leads], pa.int64()))
    columns["leads"] = one(pa.array(np.concatenate([h for _, h in block.leads]) if block.leads else np.zeros(0, np.uint64)))
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write(batch)


def opened(path: str, width: int) -> Block:
    """A block whose arrays lie in the mapped file."""
    batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
    values = {c: batch.column(c)[0].values for c in batch.schema.names}
    windows = values["windows"]
    keys = np.frombuffer(windows.buffers()[1], f"S{4 * width}")[windows.offset : windows.offset + len(windows)] if len(windows) else np.zeros(0, f"S{4 * width}")
    cuts = np.cumsum(values["lead_sizes"].to_numpy())[:-1]
    leads = list(zip(values["lead_words"].to_pylist(), np.split(values["leads"].to_numpy(), cuts), strict=True)) if len(values["lead_words"]) else []
    arrays = {c: values[c].to_numpy() for c in _ARRAYS}
    return Block(items=values["items"], windows=keys, leads=leads, **arrays)


def _searcher(files: Sequence[str], width: int) -> Callable[[pa.Array], Sequence[pa.Array]]:
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))
    only = opened(SparkFiles.get(files[0]), width) if len(files) == 1 else None

    def search(texts: pa.Array) -> Sequence[pa.Array]:
        keys, first = word_keys(texts)
        matches: list[list[dict]] = [[] for _ in range(len(texts))]
        for name in files:
            block = only or opened(SparkFiles.get(name), width)
            at, window = locations(block, keys, first, width)
            text = np.searchsorted(first, at, "right") - 1
            order = np.argsort(text, kind="stable")
            at, window, text = at[order], window[order], text[order]
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            for i in np.unique(text):
                some = slice(bounds[i], bounds[i + 1])
                for a, b, c, d in longest(block, at[some] - first[i], window[some]).tolist():
                    matches[i].append({"item_id": block.items[a].as_py(), "doc_word": b, "item_word": c, "n_words": d})
        return [pa.array(np.diff(first).astype(np.int64)), pa.array(matches, kind)]

    return search


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words, prepared one at
    a time on the driver."""
    held, size = [], 0
    for name, text in benchmark.select(ref(benchmark, item_col).cast("string"), ref(benchmark, text_col)).filter(ref(benchmark, item_col).isNotNull() & ref(benchmark, text_col).isNotNull()).toLocalIterator():
        held.append((name, text))
        size += len(text) // 6 + 1
        if size >= block_words:
            yield prepare(held, width)
            held, size = [], 0
    yield prepare(held, width)


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str, str]:
    """``docs`` with the number of words and the longest verbatim matches of
    at least ``width`` words (or a whole shorter item); also the names of the
    two added columns."""
    n_words, matches = free_name(docs, "n_words"), free_name(docs, "matches")
    files, folder = [], tempfile.mkdtemp(prefix="rinkspark-benchmark-")
    for block in blocks(benchmark, item_col, item_text_col, width, block_words):
        files.append(f"benchmark-{uuid.uuid4().hex}.arrow")
        save(block, os.path.join(folder, files[-1]), width)
        docs.sparkSession.sparkContext.addFile(os.path.join(folder, files[-1]))
    added = T.StructType([T.StructField(n_words, T.LongType()), T.StructField(matches, T._parse_datatype_string(MATCHES))])
    return map_texts(docs, text_col, lambda: _searcher(files, width), added), n_words, matches


def matched_items(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))


def words_hit(matches: Column) -> Column:
    """Words inside any match: union of the spans, in order of their begin."""
    spans = F.sort_array(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
        lambda s: s["n"],
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any match, columns as they came."""
    out, n_words, matches = with_matches(docs, benchmark, text_col)
    return out.filter(F.size(matches) == 0).select(*[ref(out, c) for c in docs.columns])
