"""Substring deduplication by content-defined chunks.

A gear rolling hash runs over a document's words (lower-cased, joined by
single spaces). It covers the 16 bytes before each word; a chunk begins at a
word whose hash is the least among its four neighbours on either side. The
choice depends on nearby text only, so the chunks of a passage are the same
wherever it stands and whatever is inserted before it.

Documents are packed in shards of a megabyte, written once and bucketed by
shard; texts are never shuffled. What shards have to tell each other goes out
packed, dealt by hash to parts, and comes back to them by shard.

1. A shard sends the digests of its chunks and is told which of them other
   shards have. Chunks that two documents hold are put in runs of adjacent
   ones. A run, its two neighbour chunks and the words that their outer cuts
   depend on bound the repeated passage; regions of 50 words or more, of the
   first document as of the later ones, are looked into.
2. Every run of 50 words inside such a region is hashed (64 bits). A shard
   sends each hash with its least document id, once, and is told the least id
   of all shards where that is another one. So a passage that a third of the
   documents hold is one entry per shard.
3. Every run of 50 words whose first holder is another document is removed
   (spans joined, up to the next space).

So a passage stays in its first document and goes from the later ones. Repeats
within one document are left to it, as are passages under 50 words.

Defined results: null and empty texts and texts under 50 words stay as they
are; rows without an id are neither changed nor compared. Rows that repeat an
id are one document: none of them is repeated by another one, and each loses
what documents of lesser ids hold. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm.common import bucketed, free_name, ref, staged
from rinkspark.llm.packing import batch_of, in_shards, planes, runs, unplaned
from rinkspark.llm.text_arrays import mixed, run_hashes, span_hashes, utf8, words

MIN_WORDS = 50
RADIUS = 4
#: Longer chunks come from words that repeat with a short period, where no
#: hash is below its neighbours. They are cut at every place of their least
#: hash that is far enough from the last cut, and so are parts still as long.
LONG_CHUNK = 32
PERIODIC = 24
#: Text bytes for which one more part of the hashes is made.
PART_BYTES = 1 << 25

#: Gear table: one pseudo-random 32-bit value per byte.
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash h = (h << 2) + gear[byte] at every byte; 32 bits hold the
    last 16 bytes. Built by doubling the span it covers."""
    h = _GEAR[data]
    span = 1
    while span < 16:
        wider = h.copy()
        wider[span:] += h[:-span] << np.uint32(2 * span)
        h, span = wider, 2 * span
    return h


def chunk_begins(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the chunks of a document, given by the lower-cased bytes
    and the places of its words, and the first word that each cut depends on.
    The first word always begins a chunk."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1  # places of the words, one space between
    joined = np.full(int(at[-1] + sizes[-1] + 1), 0x20, np.uint8)
    joined[np.repeat(at - starts, sizes) + (np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()))] = low[
        np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    ]
    value = np.full(n + 2 * RADIUS, np.iinfo(np.uint64).max, np.uint64)
    value[RADIUS : n + RADIUS] = gear(joined)[at + sizes]
    own = value[RADIUS : n + RADIUS]
    cut = np.ones(n, bool)
    for k in range(1, RADIUS + 1):
        cut &= (own < value[RADIUS - k : n + RADIUS - k]) & (own <= value[RADIUS + k : n + RADIUS + k])
    cut = np.append(True, cut[:-1])  # the hash covers the word before the cut
    begins = np.flatnonzero(cut)
    ends_at = np.append(begins[1:], n)
    long = [(b, e) for b, e in zip(begins.tolist(), ends_at.tolist(), strict=True) if e - b > LONG_CHUNK]
    while long:
        b, e = long.pop()
        inner = own[b + PERIODIC - 1 : e - 1]
        last = b
        for c in [*(b + PERIODIC + np.flatnonzero(inner == inner.min())).tolist(), e]:
            if c == e or c - last >= PERIODIC:
                if c < e:
                    cut[c] = True
                if c - last > LONG_CHUNK:
                    long.append((last, c))
                last = c
    begins = np.flatnonzero(cut)
    stop = at + sizes
    return begins, np.searchsorted(stop, stop[np.maximum(begins - 1 - RADIUS, 0)] - 16, "right")


class Shard:
    """A shard's texts as words: (shard, rows, ...) opened."""

    def __init__(self, batch: pa.RecordBatch, n: int, id_col: str):
        rows = batch.column("rows")[n].values
        names = [f.name for f in rows.type]
        self.shard, self.rows = batch.column("shard")[n].as_py(), rows
        ids = rows.field(names.index(id_col)).cast(pa.int64())
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.texts = rows.field(len(names) - 1).cast(pa.string())
        data, self.begins = utf8(pa.compute.fill_null(self.texts, ""))
        self.low, self.starts, self.ends, self.first = words(data, self.begins)
        self.keys = span_hashes(self.low, self.starts, self.ends)

    def chunks(self) -> tuple[np.ndarray, ...]:
        """Of all chunks: document (row of the shard), 64-bit digest, number in
        the document, and reach in words. The reach is the chunk, its
        neighbours and what their outer cuts depend on: a passage beyond it
        would have made a neighbour equal."""
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))]
        for i in np.flatnonzero(self.known & (np.diff(self.first) >= MIN_WORDS)).tolist():
            a, b = int(self.first[i]), int(self.first[i + 1])
            begin, seen = chunk_begins(self.low, self.starts[a:b], self.ends[a:b])
            end = np.append(begin[1:], b - a)
            found = (np.full(len(begin), i), run_hashes(self.keys[a:b], begin, end), np.arange(len(begin)), np.append(0, seen[:-1]), np.minimum(np.append(end[1:], b - a) + RADIUS, b - a))
            for p, x in zip(parts, found, strict=True):
                p.append(x)
        return tuple(np.concatenate(p) for p in parts)

    def windows(self, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs of 50 words inside the regions (document, begin, end):
        document, place and 64-bit hash."""
        docs, places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in runs(regions[:, 0]):
            i = int(regions[a, 0])
            own = self.keys[self.first[i] : self.first[i + 1]]
            inside = np.zeros(max(0, len(own) - MIN_WORDS + 1), bool)
            for _, begin, end in regions[a:b].tolist():
                inside[begin : max(0, end - MIN_WORDS + 1)] = True
            at = np.flatnonzero(inside)
            docs.append(np.full(len(at), i))
            places.append(at)
            hashes.append(run_hashes(own, at, at + MIN_WORDS))
        return np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the least and greatest id of each."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[begin], ids[begin], ids[np.append(begin, len(keys))[1:] - 1]


def _part(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)


def _digests(id_col: str, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct chunk digests (part, shard, keys) of a shard."""
        for batch in batches:
            for n in range(batch.num_rows):
                shard = Shard(batch, n, id_col)
                keys = np.unique(shard.chunks()[1])
                part = _part(keys, bits)
                yield batch_of([(int(part[a]), shard.shard, planes(keys[a:b])) for a, b in runs(part)], ["part", "shard", "keys"], [pa.int64(), pa.int64(), pa.binary()])

    return send


def _by_part(answer: Callable[[list[tuple]], Iterator[tuple]], names: list[str], kinds: list[pa.DataType]):
    """Rows ordered by part, one part held at a time: ``answer`` gets its rows
    without the part and returns rows (shard, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and held:
                    yield batch_of([(shard, last, *rest) for shard, *rest in answer(held)], names, kinds)
                    held = []
                last = part
                held.append(tuple(row))
        if held:
            yield batch_of([(shard, last, *rest) for shard, *rest in answer(held)], names, kinds)

    return run


def _shared_keys(rows: list[tuple]) -> Iterator[tuple]:
    """Which digests of each shard another shard has: (shard, bits)."""
    keys = [unplaned(raw, np.uint64) for _, raw in rows]
    _, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    often, end = count[at] > 1, 0
    for (shard, _), k in zip(rows, keys, strict=True):
        end += len(k)
        if often[end - len(k) : end].any():
            yield shard, np.packbits(often[end - len(k) : end]).tobytes()


def _first_holders(rows: list[tuple]) -> Iterator[tuple]:
    """For each shard, its hashes whose least id is another shard's (shard,
    bits), and that id (holders)."""
    keys, ids = [unplaned(k, np.uint64) for _, k, _ in rows], [unplaned(i, np.uint64).view(np.int64) for _, _, i in rows]
    every = np.concatenate(keys)
    distinct, least, _ = _least(every, np.concatenate(ids))
    end, holder = 0, least[np.searchsorted(distinct, every)]
    for (shard, _, _), own in zip(rows, ids, strict=True):
        end += len(own)
        first = holder[end - len(own) : end]
        other = first != own
        if other.any():
            yield shard, np.packbits(other).tobytes(), planes(first[other].view(np.uint64))


def _told(part: np.ndarray, back: list[dict]) -> tuple[np.ndarray, list[tuple[dict, int, int]]]:
    """Which keys (given by their sorted parts) the answers name, and where
    those of each answer begin."""
    out, at = np.zeros(len(part), bool), []
    for x in back:
        a, b = np.searchsorted(part, [x["part"], x["part"] + 1]).tolist()
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
        at.append((x, a, b))
    return out, at


def _regions(id_col: str, bits: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions (shard, regions) in which a passage of 50 words may repeat."""
        for batch in batches:
            rows = []
            for n in range(batch.num_rows):
                shard = Shard(batch, n, id_col)
                doc, digest, idx, begin, end = shard.chunks()
                keys, least, most = _least(digest, shard.ids[doc])
                told, _ = _told(_part(keys, bits), batch.column("back")[n].as_py() or [])
                at = np.flatnonzero((told | (least < most))[np.searchsorted(keys, digest)])
                opens = np.append(True, (np.diff(doc[at]) != 0) | (np.diff(idx[at]) != 1))[: len(at)]
                spans = [(doc[at[a]], begin[at[a:b]].min(), end[at[a:b]].max()) for a, b in runs(np.cumsum(opens))]
                spans = [s for s in spans if s[2] - s[1] >= MIN_WORDS]
                if spans:
                    rows.append((shard.shard, np.array(spans, np.int32).tobytes()))
            yield batch_of(rows, ["shard", "regions"], [pa.int64(), pa.binary()])

    return find


def _opened(batch: pa.RecordBatch, n: int) -> np.ndarray:
    raw = batch.column("regions")[n].as_py()
    return np.frombuffer(raw or b"", np.int32).reshape(-1, 3).astype(np.int64)


def _window_hashes(id_col: str, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct window hashes of a shard with their least id (part, shard,
        keys, ids)."""
        for batch in batches:
            for n in range(batch.num_rows):
                shard = Shard(batch, n, id_col)
                doc, _, hashes = shard.windows(_opened(batch, n))
                keys, least, _ = _least(hashes, shard.ids[doc])
                part = _part(keys, bits)
                rows = [(int(part[a]), shard.shard, planes(keys[a:b]), planes(least[a:b].view(np.uint64))) for a, b in runs(part)]
                yield batch_of(rows, ["part", "shard", "keys", "ids"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return send


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the byte spans."""
    out, at = [], 0
    for begin, end in sorted(spans):
        out.append(raw[at : max(at, begin)])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()


def _cleaner(id_col: str, bits: int, span_name: str, cut_name: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of shards with their repeated spans and the text left."""
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("holder", pa.int64()), ("n_words", pa.int32())]))
        for batch in batches:
            for n in range(batch.num_rows):
                shard = Shard(batch, n, id_col)
                doc, place, hashes = shard.windows(_opened(batch, n))
                keys, holder, _ = _least(hashes, shard.ids[doc])
                told, answers = _told(_part(keys, bits), batch.column("back")[n].as_py() or [])
                for x, a, b in answers:
                    holder[np.arange(a, b)[told[a:b]]] = unplaned(x["holders"], np.uint64).view(np.int64)
                own = holder[np.searchsorted(keys, hashes)]
                hit = own < shard.ids[doc]
                found: list[list[dict] | None] = [None] * len(shard.ids)
                cut = shard.texts.to_pylist()
                doc, place, own = doc[hit], place[hit], own[hit]
                order = np.lexsort((place, own, doc))
                doc, place, own = doc[order], place[order], own[order]
                opens = np.append(True, (np.diff(doc) != 0) | (np.diff(own) != 0) | (np.diff(place) > MIN_WORDS))[: len(doc)]
                for a, b in runs(np.cumsum(opens)):
                    i, first = int(doc[a]), int(place[a])
                    raw, last = shard.texts[int(doc[a])].as_py().encode(), int(place[b - 1]) + MIN_WORDS
                    base = int(shard.begins[i])
                    at = slice(int(shard.first[i]), int(shard.first[i + 1]))
                    begin, end = byte_span(raw, shard.starts[at] - base, shard.ends[at] - base, first, last)
                    found[i] = [*(found[i] or []), {"begin": begin, "end": end, "holder": int(own[a]), "n_words": last - first}]
                for i, spans in enumerate(found):
                    if spans:
                        found[i] = sorted(spans, key=lambda s: tuple(s.values()))
                        cut[i] = _cut(cut[i].encode(), [(s["begin"], s["end"]) for s in spans])
                columns = [shard.rows.field(k) for k in range(shard.rows.type.num_fields)]
                names = [f.name for f in shard.rows.type]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind), pa.array(cut, pa.string())], [*names, span_name, cut_name])

    return clean


def byte_span(raw: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """Bytes of the words a to b. Those up to the neighbouring white space
    belong to the span, and spaces behind it (line ends stay)."""
    begin, end = int(starts[a]), int(ends[b - 1])
    lower, upper = int(ends[a - 1]) if a else 0, int(starts[b]) if b < len(starts) else len(raw)
    while begin > lower and not raw[begin - 1 : begin].isspace():
        begin -= 1
    while end < upper and not raw[end : end + 1].isspace():
        end += 1
    while end < upper and raw[end : end + 1] in (b" ", b"\t"):
        end += 1
    return begin, end


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the spans (array of
    structs begin, end, holder, n_words, in bytes; null without any), and the
    text without them."""
    spark = docs.sparkSession
    spans, cut = (free_name(docs, c) for c in ("_spans", "_cut"))
    packed, text = in_shards(docs, text_col)
    with bucketed(spark) as tables:
        shards = tables.write(packed, "shards", "shard")
        size = shards.agg(F.sum("size")).first()[0] or 0
        bits = min(30, int(size // PART_BYTES).bit_length())
        rows = shards.select("shard", "rows")

        def answered(sent: DataFrame, answer: Callable, more: Sequence[str], name: str) -> DataFrame:
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * len(more)]
            back = sent.repartition("part").sortWithinPartitions("part")
            back = back.mapInArrow(_by_part(answer, ["shard", "part", *more], kinds), "shard bigint, part bigint, " + ", ".join(f"{c} binary" for c in more))
            return staged(back, name).groupBy("shard").agg(F.collect_list(F.struct("part", *more)).alias("back")).hint("shuffle_hash")

        shared = answered(rows.mapInArrow(_digests(id_col, bits), "part bigint, shard bigint, keys binary"), _shared_keys, ["bits"], "shared-chunks")
        regions = tables.write(rows.join(shared, "shard", "left").mapInArrow(_regions(id_col, bits), "shard bigint, regions binary"), "regions", "shard").hint("shuffle_hash")
        sent = rows.join(regions, "shard").mapInArrow(_window_hashes(id_col, bits), "part bigint, shard bigint, keys binary, ids binary")
        holders = answered(sent, _first_holders, ["bits", "holders"], "first-holders")
        kind = "array<struct<begin:int,end:int,holder:bigint,n_words:int>>"
        schema = T.StructType([*shards.schema["rows"].dataType.elementType.fields, T.StructField(spans, T._parse_datatype_string(kind)), T.StructField(cut, T.StringType())])
        out = rows.join(regions, "shard", "left").join(holders, "shard", "left").mapInArrow(_cleaner(id_col, bits, spans, cut), schema)
        return out.select(*[ref(out, text).alias(c) if c == text_col else ref(out, c) for c in docs.columns], spans, cut), spans, cut


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated passages taken out of the text; a column of
    text lengths, if named, follows the new text."""
    out, spans, cut = with_repeats(docs, id_col, text_col)
    new = {text_col: F.col(cut)}
    if length_col:
        new[length_col] = F.when(F.col(spans).isNull(), ref(out, length_col)).otherwise(F.char_length(cut)).cast(docs.schema[length_col].dataType)
    return out.select(*[new.get(c, ref(out, c)).alias(c) for c in docs.columns])
