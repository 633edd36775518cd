"""Comparing many rows with a leader each, without gathering groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from rinkspark.llm.common import ship_package, staged
from rinkspark.operators.joins import join_small

#: Members that meet one copy of their leader.
SALT_ROWS = 256


def large_groups(rows: DataFrame, key: str, size: int = SALT_ROWS) -> DataFrame:
    """Rows (key, salts) of the keys with more than ``size`` rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > size)
    return counts.select(key, F.ceil(F.col("n") / size).cast("int").alias("salts"))


def salted(rows: DataFrame, large: DataFrame, key: str, spread: str, out: str = "salt") -> DataFrame:
    """``rows`` with a salt: the rows of a large key are dealt by ``spread``.
    The large keys are broadcast if they are proven few."""
    return join_small(rows, large, key, "left").withColumn(out, F.pmod(F.xxhash64(spread), F.coalesce("salts", F.lit(1)))).drop("salts")


def join_salted(rows: DataFrame, right: DataFrame, large: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join with ``right`` (one row per key) in which no key is hot: the
    right row of a large key is there once for each salt."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts"), F.lit(1)).cast("long") - 1))
    right = join_small(right, large, key, "left").withColumn("_salt", copies).drop("salts")
    return salted(rows, large, key, spread, "_salt").join(right, [key, "_salt"]).drop("_salt")


def compare_with_leaders(
    pairs: DataFrame, payload: DataFrame, prepare: Callable[[Any], Any], compare: Callable[[int, Any, int, Any], Iterator[tuple]], schema: str
) -> DataFrame:
    """Run ``compare(a, prepared payload of a, b, payload of b)`` for every
    pair (a, b) and return the rows it yields.

    ``payload`` (id, data) has every id of ``pairs`` once. Pairs are dealt by
    (a, salt), each salt with a copy of the leader and about ``SALT_ROWS``
    members; a task streams through a leader and its members and holds one
    leader at a time, so a leader of a third of all rows is just many salts.
    """
    ship_package(pairs.sparkSession)
    large = staged(large_groups(pairs, "a"), "large-leaders")
    dealt = salted(pairs.select("a", "b"), large, "a", "b")
    members = dealt.join(payload, dealt["b"] == payload["id"]).select("a", "salt", F.lit(1).alias("role"), "b", "data")
    leaders = dealt.select("a", "salt").distinct().join(payload, F.col("a") == payload["id"]).select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "data")
    rows = leaders.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held = None, None
        for batch in batches:
            found: list[tuple] = []
            for a, role, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "b", "data")), strict=True):
                if role == 0:
                    leader, held = a, prepare(data)
                elif leader == a:
                    found.extend(compare(a, held, b, data))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)
