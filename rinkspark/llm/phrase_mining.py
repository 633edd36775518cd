"""Phrase collocations from an FM-index per shard, counts summed across shards.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends,
and pieces into words at blanks. Everything is counted per language.

1. A shard is about 400,000 words of one language in one partition. Its
   word numbers in text order, a 0 at every piece end, are indexed: the
   Burrows-Wheeler transforms of the shard and of its reverse (suffixes ordered
   by their first eight words, which searches of up to eight words need).
   Indexes are written once, bucketed by shard, and never shuffled.
2. A phrase is a pair of intervals, in both transforms. The symbols in its
   interval of the reversed transform are its right extensions, and their
   counts give the intervals of the longer phrases. Words and pairs are counted
   all; from three words on, phrases grow from frequent ones by one word a
   round, and only such are counted whose last words are a frequent phrase as
   well (left extension: one step in the forward transform).
3. A shard sends the number of each of its phrases under a key of 32 bits and
   more (the upper bits deal keys to parts, their number grows with the words),
   packed in one row for each part. A part is summed in one task, a few
   megabytes of keys, and answers every shard with a bitmap of the keys that
   may reach ``min_count`` in all: none that does is left out.
4. The shards spell the phrases of those keys, packed for the same parts, and
   sums by language and phrase decide exactly. Nothing is broadcast.

A phrase sends one entry per shard that holds it, so on very large input
``SHARD_WORDS`` is to be raised, to keep the entries of a common word in the
millions.

Scores, cuts and the test for longer phrases are joins of the frequent phrases.

Defined results: null and empty texts have no words; a null language is
``und``; ids and other columns are not looked at, repeated rows count each.
An empty table gives no rows. Counts are exact, and scores are computed in
decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.llm.common import bucketed, pieces, ref, ship_package, staged
from rinkspark.llm.packing import batch_of, planes, runs, unplaned
from rinkspark.llm.text_arrays import LOWER, mixed, span_hashes, utf8
from rinkspark.operators.joins import join_small

MAX_WORDS = 5
MIN_COUNT = 100
#: Words of one language up to which a shard is filled (a megabyte of text, or
#: one longer document, may be more), and words of all languages that a task
#: holds back.
SHARD_WORDS = 400_000
HELD_WORDS = 1 << 20
#: Words for which one more part of the keys is made.
PART_WORDS = 1 << 21

_STEP = np.uint64(0x100000001B3)
_BYTES = np.arange(256)
_ENDS = np.isin(_BYTES, [*b".,;:!?", *range(0x0A, 0x0E)])
_INSIDE = ~_ENDS & ~np.isin(_BYTES, [0x20, 0x09])


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, end to end, and which of them begin a piece."""
    data, begins = utf8(texts)
    low = LOWER[data]
    inside = _INSIDE[low]
    first = np.zeros(len(low) + 1, bool)
    first[begins[:-1]] = True
    first = first[:-1]
    before = np.append(False, inside[:-1])
    after = np.append(inside[1:] & ~first[1:], False)
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(inside & ~after) + 1
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    piece = np.cumsum(_ENDS[low].astype(np.int32) + first)[starts]
    return words, np.append(True, piece[1:] != piece[:-1])[: len(starts)]


def _narrow(values: np.ndarray, top: int) -> bytes:
    return values.astype(np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _wide(raw: bytes, top: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if top < 1 << 16 else np.uint32)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexes (shard, lang, n, words, bwt, reverse) of rows (lang, text)."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def index(lang: str) -> pa.RecordBatch:
        nonlocal number
        parts = held.pop(lang)
        sizes.pop(lang)
        coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64) + 1
        opens = np.concatenate([o for _, o in parts])
        seq = np.zeros(len(ids) + int(opens.sum()) + 1, np.int64)
        seq[np.arange(len(ids)) + np.cumsum(opens)] = ids
        top = len(coded.dictionary)
        columns = [
            pa.array([number], pa.int64()),
            pa.array([lang]),
            pa.array([len(ids)], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, top], pa.int32()), coded.dictionary),
            pa.array([_narrow(transform(seq), top)], pa.binary()),
            pa.array([_narrow(transform(seq[::-1]), top)], pa.binary()),
        ]
        number += 1
        return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "n", "words", "bwt", "reverse"])

    for whole in batches:
        for batch in pieces(whole, 1):
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                words, opens = tokens(batch.column(1).filter(pa.array(code == k)))
                if len(words):
                    if lang in held and sizes[lang] + len(words) > SHARD_WORDS:
                        yield index(lang)
                    held.setdefault(lang, []).append((words, opens))
                    sizes[lang] = sizes.get(lang, 0) + len(words)
            while sum(sizes.values()) >= HELD_WORDS:
                yield index(max(sizes, key=sizes.get))
    for lang in sorted(held):
        yield index(lang)


def transform(seq: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of a sequence that begins and ends with 0, its
    suffixes ordered by their first eight symbols."""
    n, rank = len(seq), seq.astype(np.int64)
    for span in (1, 2, 4):
        later = np.zeros(n, np.int64)
        later[: max(0, n - span)] = rank[span:] + 1
        key = rank * (n + int(rank.max()) + 2) + later
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1]))
    return seq[order - 1]


class FmIndex:
    """Both transforms of a shard over symbols 1 to V (0 ends a piece)."""

    def __init__(self, bwt: np.ndarray, reverse: np.ndarray, symbols: int):
        self.reverse = reverse
        self.next_row = np.argsort(bwt, kind="stable").astype(np.int32)  # row of the suffix without its first symbol
        self.first = np.repeat(np.arange(symbols + 1, dtype=np.int32), np.bincount(bwt, minlength=symbols + 1))
        self.reverse_step = np.empty(len(reverse), np.int32)  # last-to-first mapping of the reverse
        self.reverse_step[np.argsort(reverse, kind="stable")] = np.arange(len(reverse), dtype=np.int32)
        self.symbols = symbols

    def roots(self) -> np.ndarray:
        """Rows (lo, size, lo in the reverse) of all symbols; both transforms
        hold the same symbols, so the places are the same."""
        counts = np.bincount(self.first, minlength=self.symbols + 1)
        lo = np.cumsum(counts) - counts
        return np.stack([lo, counts, lo], axis=1)[1:]

    def extended(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes of one more word on the right, if their words but the
        first are one of ``nodes``, too."""
        lo, size, rlo = nodes.T
        rows = _ranges(rlo, size)
        owner = np.repeat(np.arange(len(nodes)), size)
        key = owner * (self.symbols + 1) + self.reverse[rows]
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        count = np.diff(np.append(begin, len(key)))
        owner, symbol = np.divmod(key[begin], self.symbols + 1)
        back = np.minimum.reduceat(self.reverse_step[rows[order]], begin) if len(begin) else begin
        out = np.stack([lo[owner] + begin - (np.cumsum(size) - size)[owner], count, back], axis=1)
        known = np.zeros(len(self.reverse), bool)
        known[_ranges(lo, size)] = True
        return out[(symbol > 0) & known[self.next_row[out[:, 0]]]]

    def spelled(self, nodes: np.ndarray, depth: int) -> list[np.ndarray]:
        """Symbols of the phrases of ``nodes``, one array per place."""
        row, out = nodes[:, 0], []
        for _ in range(depth):
            out.append(self.first[row])
            row = self.next_row[row]
        return out


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(lo - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Shard:
    """A row (shard, lang, words, bwt, reverse, nodes) opened, with the nodes
    that its round counts (``found``: sizes, nodes) and their keys, parts and
    the order in which they are sent."""

    def __init__(self, batch: pa.RecordBatch, n: int, depth: int, bits: int):
        self.shard, self.lang, raw, back = (batch.column(c)[n].as_py() for c in ("shard", "lang", "bwt", "reverse"))
        self.words = batch.column("words")[n].values
        self.index = FmIndex(_wide(raw, len(self.words)), _wide(back, len(self.words)), len(self.words))
        if depth == 1:
            nodes = self.index.roots()
            found = [nodes, self.index.extended(nodes)]
        else:
            found = [self.index.extended(np.frombuffer(batch.column("nodes")[n].as_py(), np.int32).reshape(-1, 3).astype(np.int64))]
        self.size = np.repeat(np.arange(len(found)) + (1 if depth == 1 else depth + 1), [len(x) for x in found])
        self.nodes = np.concatenate(found)
        self.key = np.concatenate([self._keys(size, self.nodes[self.size == size]) for size in np.unique(self.size)] or [np.zeros(0, np.uint64)]) >> np.uint64(32 - bits)
        self.part = (self.key >> np.uint64(32)).astype(np.int64)
        many = (self.nodes[:, 1] > 1).astype(np.uint64)
        self.order = np.argsort((self.key >> np.uint64(32) << np.uint64(33)) | (many << np.uint64(32)) | (self.key & np.uint64(0xFFFFFFFF)))

    def _keys(self, size: int, nodes: np.ndarray) -> np.ndarray:
        """64-bit keys of the phrases of ``nodes``, of ``size`` words."""
        data, begins = utf8(self.words)
        own = span_hashes(data, begins[:-1], begins[1:])
        key = np.full(len(nodes), zlib.crc32(self.lang.encode()), np.uint64)
        for symbol in self.index.spelled(nodes, size):
            key = mixed(key * _STEP + own[symbol - 1])
        return key

    def frequent(self, back: list[dict]) -> np.ndarray:
        """Which nodes the answers (part, bits) name."""
        told = np.zeros(len(self.nodes), bool)
        parts = self.part[self.order]
        for x in back:
            a, b = np.searchsorted(parts, [x["part"], x["part"] + 1]).tolist()
            told[self.order[a:b]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
        return told


def _sent(depth: int, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed counts (part, shard, once, keys, counts) of a shard's phrases:
        keys that occur once, the others, and the counts of these."""
        for batch in batches:
            for n in range(batch.num_rows):
                shard = Shard(batch, n, depth, bits)
                key, part, count = shard.key[shard.order].astype(np.uint32), shard.part[shard.order], shard.nodes[shard.order, 1].astype(np.uint32)
                rows = []
                for a, b in runs(part):
                    m = a + int(np.searchsorted(count[a:b] > 1, True))
                    rows.append((int(part[a]), shard.shard, planes(key[a:m]), planes(key[m:b]), planes(count[m:b])))
                yield batch_of(rows, ["part", "shard", "once", "keys", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])

    return send


def _summed(min_count: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers (shard, part, bits): which of its keys reach ``min_count``
        over all shards. Rows come ordered by part; one part is held at a time."""
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def told(part: int) -> pa.RecordBatch:
            key, count = np.concatenate([k for _, k, _ in held]), np.concatenate([c for _, _, c in held])
            at = np.unique(key, return_inverse=True)[1]
            often = (np.bincount(at, count) >= min_count)[at]
            ends = np.cumsum([len(k) for _, k, _ in held]).tolist()
            rows = [(shard, part, often[e - len(k) : e]) for (shard, k, _), e in zip(held, ends, strict=True)]
            return batch_of([(shard, p, np.packbits(x).tobytes()) for shard, p, x in rows if x.any()], ["shard", "part", "bits"], [pa.int64(), pa.int64(), pa.binary()])

        last = None
        for batch in batches:
            for part, shard, once, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and held:
                    yield told(last)
                    held = []
                last, single, more = part, unplaned(once), unplaned(keys)
                held.append((shard, np.concatenate([single, more]), np.concatenate([np.ones(len(single)), unplaned(counts)])))
        if held:
            yield told(last)

    return add


def _kept(depth: int, bits: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The longest nodes (shard, nodes) that the answers name."""
        for batch in batches:
            rows = []
            for n in range(batch.num_rows):
                shard = Shard(batch, n, depth, bits)
                nodes = shard.nodes[shard.frequent(batch.column("back")[n].as_py()) & (shard.size == depth + 1)]
                if len(nodes):
                    rows.append((shard.shard, nodes.astype(np.int32).tobytes()))
            yield batch_of(rows, ["shard", "nodes"], [pa.int64(), pa.binary()])

    return keep


def _spelled(depth: int, bits: int):
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases (part, lang, words, phrases, counts) of the nodes that the
        answers name, summed over the shards of a batch and packed by part."""
        import pyarrow.compute as pc

        for batch in batches:
            found: dict[tuple[str, int], list[tuple[pa.Array, np.ndarray, np.ndarray]]] = {}
            for n in range(batch.num_rows):
                shard = Shard(batch, n, depth, bits)
                told = shard.frequent(batch.column("back")[n].as_py())
                for size in np.unique(shard.size[told]).tolist():
                    mine = np.flatnonzero(told & (shard.size == size))
                    phrases = pc.binary_join_element_wise(*[shard.words.take(pa.array(s - 1)) for s in shard.index.spelled(shard.nodes[mine], size)], " ")
                    found.setdefault((shard.lang, size), []).append((phrases, shard.nodes[mine, 1], shard.part[mine]))
            for (lang, size), rows in found.items():
                coded = pa.concat_arrays([p for p, _, _ in rows]).dictionary_encode()
                at = coded.indices.to_numpy()
                total = np.bincount(at, np.concatenate([c for _, c, _ in rows])).astype(np.int64)
                part = np.empty(len(total), np.int64)
                part[at] = np.concatenate([p for _, _, p in rows])
                order = np.argsort(part, kind="stable")
                part = part[order]
                begins = [a for a, _ in runs(part)]
                offsets = pa.array([*begins, len(part)], pa.int32())
                columns = [
                    pa.array(part[begins]),
                    pa.array([lang] * len(begins), pa.string()),
                    pa.array([size] * len(begins), pa.int32()),
                    pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(order))),
                    pa.ListArray.from_arrays(offsets, pa.array(total[order])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "lang", "words", "phrases", "counts"])

    return spell


def _decided(min_count: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases (lang, words, phrase, a) that reach ``min_count`` over all
        shards. Rows come ordered by part; one part is held at a time."""
        held: dict[tuple[str, int], list[tuple[pa.Array, np.ndarray]]] = {}

        def frequent() -> Iterator[pa.RecordBatch]:
            for (lang, size), found in held.items():
                coded = pa.concat_arrays([p for p, _ in found]).dictionary_encode()
                total = np.bincount(coded.indices.to_numpy(), np.concatenate([c for _, c in found])).astype(np.int64)
                often = np.flatnonzero(total >= min_count)
                columns = [pa.array([lang] * len(often), pa.string()), pa.array(np.full(len(often), size, np.int32)), coded.dictionary.take(pa.array(often)), pa.array(total[often])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "a"])

        last = None
        for batch in batches:
            parts, langs, sizes = (batch.column(c).to_pylist() for c in ("part", "lang", "words"))
            for n, part in enumerate(parts):
                if part != last:
                    yield from frequent()
                    held = {}
                last = part
                held.setdefault((langs[n], sizes[n]), []).append((batch.column("phrases")[n].values, batch.column("counts")[n].values.to_numpy()))
        yield from frequent()

    return decide


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, words, phrase, a) of 1 to ``max_words`` words that occur
    ``min_count`` times or more, and the number of words (lang, n)."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(ref(docs, lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(ref(docs, text_col), F.lit("")).alias("text"))
    out = None
    with bucketed(docs.sparkSession) as tables:
        indexes = tables.write(texts.mapInArrow(_index_rows, "shard bigint, lang string, n bigint, words array<string>, bwt binary, reverse binary"), "indexes", "shard")
        totals = staged(indexes.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        n_words = totals.agg(F.sum("n")).first()[0] or 0
        bits = min(30, (n_words // PART_WORDS).bit_length())
        opened = indexes.select("shard", "lang", "words", "bwt", "reverse")
        source = opened
        for depth in range(1, max(2, max_words)):
            sent = source.mapInArrow(_sent(depth, bits), "part bigint, shard bigint, once binary, keys binary, counts binary")
            told = sent.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(min_count), "shard bigint, part bigint, bits binary")
            back = staged(told, f"answers-{depth + 1}").groupBy("shard").agg(F.collect_list(F.struct("part", "bits")).alias("back"))
            answered = source.join(back.hint("shuffle_hash"), "shard")
            phrases = answered.mapInArrow(_spelled(depth, bits), "part bigint, lang string, words int, phrases array<string>, counts array<bigint>")
            phrases = phrases.repartition("part").sortWithinPartitions("part").mapInArrow(_decided(min_count), "lang string, words int, phrase string, a bigint")
            phrases = staged(phrases, f"phrases-{depth + 1}")
            out = phrases if out is None else out.unionByName(phrases)
            if depth + 1 < max_words:
                nodes = tables.write(answered.mapInArrow(_kept(depth, bits), "shard bigint, nodes binary"), f"nodes_{depth + 1}", "shard")
                source = opened.join(nodes.hint("shuffle_hash"), "shard")
    return out.filter(F.col("words") <= max_words).select("lang", "words", "phrase", "a"), totals


def _part(words: Column, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = 2000, share: int = 100) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a,
    l, r, n, score.

    A candidate is a frequent phrase of two words or more. Cut after k words
    into parts that occur l and r times it scores floor(1000 a n / (l r)); its
    lowest cut counts (ties: the smallest k). A candidate inside a longer one
    that has ``share`` percent of its count or more is left out; as counts fall
    with length, phrases of one word more decide that."""
    phrases, totals = frequent_phrases(docs, text_col, lang_col, max_words, min_count)
    candidates = phrases.filter("words > 1").withColumn("w", F.split("phrase", " ")).withColumnRenamed("words", "size")

    def counts(side: str) -> DataFrame:
        return phrases.select("lang", F.col("phrase").alias(f"{side}_phrase"), F.col("a").alias(side))

    cuts = candidates.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("l_phrase"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("r_phrase"))
    cuts = cuts.join(counts("l"), ["lang", "l_phrase"]).join(counts("r"), ["lang", "r_phrase"])
    cuts = join_small(cuts, totals, "lang")
    score = F.expr("CAST(CAST(a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0)) * 1000 AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))

    longer = candidates.select("lang", "a", F.explode(F.array(_part(F.col("w"), F.lit(1), F.col("size") - 1), _part(F.col("w"), F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("cut.a") * share))
    kept = kept.select("lang", "phrase", *[F.col(f"cut.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
