"""Rows that hold many values each: shards of documents, sorted numbers as byte
planes, and Arrow batches from Python rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rinkspark.llm.common import free_name, ref, ship_package

#: Text bytes up to which a shard of documents is filled (numpy works on a shard
#: at a time, at some forty bytes for each of text).
SHARD_BYTES = 1 << 20


def planes(values: np.ndarray) -> bytes:
    """Unsigned values byte by byte, all first bytes first: sorted ones pack
    well."""
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def unplaned(raw: bytes, kind: type = np.uint32) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).reshape(-1)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return zip(begin.tolist(), np.append(begin, len(values))[1:].tolist(), strict=True)


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def in_shards(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """Rows (shard, size, rows): the rows of ``docs``, some megabytes of text
    each, as an array of structs in which the text column comes last, under a
    name of its own; and that name. Partitions are cut, not shuffled."""
    ship_package(docs.sparkSession)
    text = free_name(docs, "_text")
    source = docs.select(*[ref(docs, c) for c in docs.columns if c != text_col], ref(docs, text_col).alias(text))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("size", T.LongType()), T.StructField("rows", T.ArrayType(source.schema))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held, size = [], 0

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            listed = pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), pa.StructArray.from_arrays(whole.columns, fields=list(whole.schema)))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), listed], ["shard", "size", "rows"])

        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
            begin = 0
            for n, length in enumerate(lengths.tolist()):
                if size and size + length > SHARD_BYTES:
                    held.append(batch.slice(begin, n - begin))
                    yield shard()
                    number, held, size, begin = number + 1, [], 0, n
                size += length
            held.append(batch.slice(begin))
        if sum(b.num_rows for b in held):
            yield shard()

    return source.mapInArrow(cut, schema), text
