"""Token ids in binary files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk
of every id, level 1 the second chunk of those that need one, and so on. Each
level but the last has a bitmap of ids that go on, and a rank directory (ones
before every 512th bit), so the place of an id's chunk on the next level is one
directory entry plus a count of at most 512 bits: any id, or any range of ids,
is read without decoding what lies before it.

A file holds one segment: whole documents of at least ``SEGMENT_TOKENS`` ids
together (fewer in the last of a task, more if one document is longer), with
the ids and begins of its documents. Files are written and committed by
Spark's own file sink and read by its binary reader, on whatever store the
shared folder is.

Order: documents are range-partitioned and sorted by doc_id (equal ids by
text, a null id first); a segment's header carries its partition and its number
there, which order the segments.

Defined results: a null text is empty; every document ends with ``end_id``, so
an empty one has one id; repeated rows are stored each. Columns other than id
and text are not stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkspark.llm.common import pieces, ref, ship_package, staged, work_dir
from rinkspark.llm.word_pieces import WORD_PATTERN, Memo, cutter, library_encoder, load

MAGIC = 0x31434144
SEGMENT_TOKENS = 1 << 20
BLOCK_BITS = 512
_HEAD = 8  # 64-bit header fields before the level sizes


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def _directory(bits: np.ndarray) -> np.ndarray:
    """Ones before each block of the bitmap."""
    blocks = -(-len(bits) // BLOCK_BITS)
    ones = np.add.reduceat(bits, np.arange(blocks) * BLOCK_BITS, dtype=np.int64) if blocks else np.zeros(0, np.int64)
    return (np.cumsum(ones) - ones).astype("<u4")


def pack(ids: np.ndarray, begins: np.ndarray, doc_ids: list[int | None], partition: int, number: int) -> bytes:
    """Bytes of one segment."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(8)
        bits = (more > 0).astype(np.uint8)
        levels.append(((rest & np.uint32(0xFF)).astype(np.uint8), bits))
        if not bits.any():
            break
        rest = more[bits == 1]
    head = [MAGIC, partition, number, len(doc_ids), len(ids), len(levels), 0, 0] + [len(c) for c, _ in levels]
    out = [np.array(head, "<i8").tobytes(), begins.astype("<i8").tobytes()]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), _padded(np.array([d is None for d in doc_ids], np.uint8).tobytes())]
    for k, (chunks, bits) in enumerate(levels):
        out.append(_padded(chunks.tobytes()))
        if k + 1 < len(levels):
            out += [_padded(np.packbits(bits, bitorder="little").tobytes()), _padded(_directory(bits).tobytes())]
    return b"".join(out)


class Segment:
    """Views of a segment's bytes; nothing is decoded until asked for."""

    def __init__(self, raw: bytes):
        head = np.frombuffer(raw, "<i8", _HEAD)
        if head[0] != MAGIC:
            raise ValueError("not a token segment")
        self.partition, self.number, n_docs, self.n_tokens, n_levels = (int(x) for x in head[1:6])
        sizes = np.frombuffer(raw, "<i8", n_levels, _HEAD * 8).tolist()
        at = (_HEAD + n_levels) * 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            view = np.frombuffer(raw, kind, n, at)
            at += view.nbytes + -view.nbytes % 8
            return view

        self.begins = take("<i8", n_docs + 1)
        self.doc_ids, self.null_ids = take("<i8", n_docs), take("u1", n_docs)
        self.levels = []
        for k, n in enumerate(sizes):
            chunks = take("u1", n)
            last = k + 1 == n_levels
            self.levels.append((chunks, None if last else take("u1", -(-n // 8)), None if last else take("<u4", -(-n // BLOCK_BITS))))

    def _rank(self, level: int, i: int) -> int:
        """Ids of the level before ``i`` that go on to the next one."""
        _, bits, directory = self.levels[level]
        if i == 0:
            return 0
        block = (i - 1) // BLOCK_BITS
        first = block * BLOCK_BITS // 8
        tail = np.unpackbits(bits[first : -(-i // 8)], bitorder="little")[: i - block * BLOCK_BITS]
        return int(directory[block]) + int(tail.sum())

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at positions a to b."""
        out = np.zeros(max(0, b - a), np.uint32)
        rows = np.arange(len(out))
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[rows] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            if bits is None or a >= b:
                break
            on = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a - a // 8 * 8 :][: b - a] == 1
            a = self._rank(level, a)
            rows = rows[on]
            b = a + len(rows)
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode all texts, append ``end_id`` to each, and write the segments in
    order of the ids below ``path``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)
    ordered = docs.select(ref(docs, id_col).cast("long").alias("id"), F.coalesce(ref(docs, text_col), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        tok = load(shared.value)
        memo = Memo(tok, cutter(tok, WORD_PATTERN, lower=True), library_encoder(tok))
        partition, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        sizes: list[int] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            raw = pack(np.concatenate(held), np.cumsum([0, *sizes]), names, partition, number)
            number += 1
            held.clear(), sizes.clear(), names.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["segment"])

        total = 0
        for whole in batches:
            for batch in pieces(whole, 1):
                ids, begins = memo.encode(batch.column(1).to_pylist())
                ends = begins[1:]
                held.append(np.insert(ids, ends, end_id).astype(np.uint32))
                sizes += (np.diff(begins) + 1).tolist()
                names += batch.column(0).to_pylist()
                total += len(held[-1])
                if total >= segment_tokens:
                    yield close()
                    total = 0
        if names:
            yield close()

    # A segment's bytes pass through the text sink as they are, one row a file.
    rows = ordered.mapInArrow(segments, "segment binary").select(F.col("segment").cast("string").alias("value"))
    rows.write.option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents in the files: doc_id, the segment's ``partition`` and
    ``number``, ``row`` and ``start`` within the segment, ``n_tokens``, and
    ``ids`` as little-endian 32-bit integers."""
    ship_package(spark)
    schema = "doc_id bigint, partition bigint, number bigint, row bigint, start bigint, n_tokens bigint, ids binary"
    names = ["doc_id", "partition", "number", "row", "start", "n_tokens", "ids"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_buffer()
                if raw is None or raw.size < _HEAD * 8:
                    continue
                s = Segment(raw)
                n = len(s.doc_ids)
                ids, at = s.slice(0, s.n_tokens).astype("<u4").tobytes(), (s.begins * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids, mask=s.null_ids == 1),
                        pa.array(np.full(n, s.partition)),
                        pa.array(np.full(n, s.number)),
                        pa.array(np.arange(n)),
                        pa.array(s.begins[:-1]),
                        pa.array(np.diff(s.begins)),
                        pa.array([ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    ],
                    names,
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(documents, schema)


def with_global_start(rows: DataFrame) -> DataFrame:
    """Replace ``start`` by the number of ids of all documents before.

    Totals per segment are summed within each partition, and the partitions'
    totals (one row each) by one ordered window.
    """
    segments = rows.groupBy("partition", "number").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(within), F.lit(0))
    partitions = segments.groupBy("partition").agg(F.sum("n").alias("n"))
    across = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    bases = partitions.select("partition", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    starts = segments.select("partition", "number", before.alias("before")).join(bases, "partition").select("partition", "number", (F.col("base") + F.col("before")).alias("segment_start"))
    return rows.join(starts, ["partition", "number"]).withColumn("start", F.col("segment_start") + F.col("start")).drop("segment_start")


def stored_tokens(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Write the documents' ids to new files in the shared folder, read them
    back: doc_id, start (over all files), n_tokens, crc32 of the ids."""
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_json, end_id)
    back = read_tokens(docs.sparkSession, path).withColumn("crc32", F.crc32("ids")).drop("ids", "row")
    return with_global_start(staged(back, "token-rows")).select("doc_id", "start", "n_tokens", "crc32")


def token_at(segment: bytes) -> Callable[[int], int]:
    """Random access to the ids of a segment."""
    return Segment(segment).__getitem__
