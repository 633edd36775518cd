"""A partitioned table whose commits are atomic, with a key index.

    root/data/commit=C/<partition folders>    rows that commit C wrote
    root/index/commit=C/bucket=B              (key part, partition) pairs
    root/manifest/commit=C                    which commit holds each live
                                              partition and index bucket
    root/_CURRENT                             append-only pointer lines

A merge writes new folders only, then its manifest, then one pointer line. The
pointer is the commit: before it readers see the old table, after it the new
one, and a job that dies in between leaves folders that nobody names. A reader
keeps the table that it opened, as no folder is ever overwritten. One writer at
a time is assumed.

The index holds the partitions of each value of ``index_on`` (a game's season
and date), hash-dealt to buckets. A merge reads the buckets of its batch, so it
finds the old rows of its keys in the partitions concerned without a scan of
the table, however many keys the batch has.

Partitions and buckets are named to the scan as folders, from the manifest:
one row per live partition, read through the driver up to ``max_listed`` rows
(days times seasons); beyond, the manifest is joined on the partition columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.sources.store import _current_pointer, _write_pointer, conform, latest_per_key

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Characters that Spark writes as %XX in partition folder names.
_ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}
_FRESH = "_fresh"


def _folder(column: str, value) -> str:
    text = NULL_PARTITION if value is None or value == "" else "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in str(value))
    return f"{column}={text}"


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality of the columns of two frames."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


class PartitionedTable:
    """``schema`` holds the key, the partition columns and ``index_on``. With a
    ``version`` column (kept beside the schema) a row replaces another of its
    key only if its version is not less; a null version is the oldest."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        *,
        key: Sequence[str],
        partition_by: Sequence[str],
        index_on: str,
        sort_by: Sequence[str] = (),
        version: str | None = None,
        buckets: int = 64,
        max_listed: int = 100_000,
    ):
        self.spark, self.root = spark, root
        self.key, self.parts, self.index_on = list(key), list(partition_by), index_on
        self.sort_by, self.version, self.buckets, self.max_listed = list(sort_by), version, buckets, max_listed
        self.columns = schema.names
        extra = [T.StructField(version, T.TimestampType())] if version else []
        self.schema = T.StructType([*schema.fields, *extra])
        types = {f.name: f.dataType for f in schema.fields}
        part_fields = [T.StructField(c, types[c]) for c in self.parts]
        self.index_schema = T.StructType([T.StructField(index_on, types[index_on]), *part_fields, T.StructField("bucket", T.IntegerType())])
        # ``written``: how many partitions (buckets) the commit wrote.
        self.manifest_schema = T.StructType(
            [T.StructField("kind", T.StringType()), T.StructField("commit", T.StringType()), T.StructField("written", T.LongType()), *part_fields, T.StructField("bucket", T.IntegerType())]
        )

    # ------------------------------------------------------------ reading
    def exists(self) -> bool:
        return _current_pointer(self.spark, self.root) is not None

    def manifest(self) -> DataFrame:
        current = _current_pointer(self.spark, self.root)
        if current is None:
            return self.spark.createDataFrame([], self.manifest_schema)
        return self.spark.read.schema(self.manifest_schema).parquet(current[1])

    def _bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _open(self, kind: str, live: DataFrame) -> DataFrame:
        """The rows of the live partitions (or buckets) that ``live`` names."""
        columns, schema = (self.parts, self.schema) if kind == "data" else (["bucket"], self.index_schema)
        base = f"{self.root}/{kind}"
        listed = live.select("commit", "written", *columns).limit(self.max_listed + 1).collect()
        if len(listed) <= self.max_listed:
            by_commit: dict[str, list] = {}
            for r in listed:
                by_commit.setdefault(r["commit"], []).append(r)
            paths = []
            for commit, rows in sorted(by_commit.items()):
                if rows[0]["written"] == len(rows):
                    paths.append(f"{base}/commit={commit}")
                else:
                    paths.extend("/".join([base, f"commit={commit}", *[_folder(c, r[c]) for c in columns]]) for r in rows)
            if not paths:
                return self.spark.createDataFrame([], schema)
            return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("commit", T.StringType())])).parquet(base)
        return rows.join(live, same(rows, live, ["commit", *columns]), "left_semi").select(*schema.names)

    def _all(self, live: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
        live = live.filter("kind = 'data'")
        if partitions is not None:
            live = live.join(partitions, same(live, partitions, self.parts), "left_semi")
        return self._open("data", live)

    def read(self, partitions: DataFrame | None = None) -> DataFrame:
        """The current rows; of the given partitions only, if any are given."""
        return self._all(self.manifest(), partitions).select(*self.columns)

    def partitions_of(self, values: DataFrame) -> DataFrame:
        """Partitions that hold rows of the given values of ``index_on``; reads
        the index buckets of these values only."""
        return self._in(self._index(self.manifest(), values), values)

    def _buckets(self, values: DataFrame) -> DataFrame:
        return values.select(self._bucket(F.col(self.index_on)).alias("bucket")).distinct()

    def _index(self, live: DataFrame, values: DataFrame) -> DataFrame:
        return self._open("index", live.filter("kind = 'index'").join(self._buckets(values), "bucket", "left_semi"))

    def _in(self, index: DataFrame, values: DataFrame) -> DataFrame:
        return index.join(values, self.index_on, "left_semi").select(*self.parts).distinct()

    # ------------------------------------------------------------ writing
    def _staged(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/_staging/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def merge(self, batch: DataFrame) -> str:
        """Replace the rows of the batch's keys, wherever they are, in one
        commit; only partitions of old and new rows are rewritten. Returns the
        commit's name."""
        order = [self.version] if self.version else []
        fresh = self._staged(latest_per_key(conform(batch, self.schema), self.key, order), "fresh")
        values = self._staged(fresh.select(self.index_on).distinct(), "values")
        live = self.manifest()
        old_index = self._index(live, values)
        touched = self._staged(self._in(old_index, values).unionByName(fresh.select(*self.parts)).distinct(), "touched")

        both = self._all(live, touched).withColumn(_FRESH, F.lit(0)).unionByName(fresh.withColumn(_FRESH, F.lit(1)))
        current = _current_pointer(self.spark, self.root)
        # Into a new table: the batch is one row per key already.
        merged = fresh if current is None else latest_per_key(both, self.key, [*order, _FRESH]).drop(_FRESH)
        n = 0 if current is None else current[0] + 1
        commit = f"{n:09d}-{uuid.uuid4().hex[:12]}"
        data = f"{self.root}/data/commit={commit}"
        # Rows of a partition meet in few files; a large one is split (rebalance).
        merged.hint("rebalance", *self.parts).sortWithinPartitions(*self.parts, *self.sort_by).write.partitionBy(*self.parts).parquet(data)

        # One narrow pass over what was written: for the index and the manifest.
        written = self._staged(self.spark.read.schema(self.schema).parquet(data).select(self.index_on, *self.parts).distinct(), "written")
        pairs = written.join(values, self.index_on, "left_semi")
        pairs = pairs.withColumn("bucket", self._bucket(F.col(self.index_on)))
        index = old_index.join(values, self.index_on, "left_anti").unionByName(pairs)
        index.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.index_on).write.partitionBy("bucket").parquet(f"{self.root}/index/commit={commit}")

        self._commit(n, commit, live, {"data": (written.select(*self.parts), touched), "index": (index.select("bucket"), self._buckets(values))})
        return commit

    def _commit(self, n: int, commit: str, live: DataFrame, written: dict[str, tuple[DataFrame, DataFrame]]) -> None:
        """``written``: for data and index, the partitions that the commit wrote
        and those that it replaces."""
        rows = []
        for kind, (new, replaced) in written.items():
            kept = live.filter(F.col("kind") == kind)
            rows.append(kept.join(replaced, same(kept, replaced, replaced.columns), "left_anti"))
            # One group: the partitions of a commit, names only.
            count = F.count("*").over(Window.partitionBy(F.lit(kind)))
            named = new.distinct().withColumns({"kind": F.lit(kind), "commit": F.lit(commit), "written": count})
            rows.append(conform(named, self.manifest_schema))
        path = f"{self.root}/manifest/commit={commit}"
        reduce(DataFrame.unionByName, rows).coalesce(1).write.parquet(path)  # one row per live partition
        _write_pointer(self.spark, self.root, path, n)
