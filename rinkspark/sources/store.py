"""Table store on Parquet: append, truncate-and-reload, upserts, contracts.

Plain Parquet has no MERGE, so an upsert is a DataFrame expression
(anti-join + union, or a full outer join for partial columns) whose result
is written as a new snapshot directory; a small pointer file names the
current snapshot. A path is never overwritten while it is being read.
Upserts of a partitioned fact can instead overwrite only the touched
partitions (``spark.sql.sources.partitionOverwriteMode=dynamic``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark import schemas


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its store. Only Spark's own "path not
    found" answers no; any other error (no permission, a store that is down)
    is raised, so a table that cannot be read is never taken for missing."""
    try:
        spark.read.schema("x int").parquet(path)
    except AnalysisException as ex:
        if ex.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


# ------------------------------------------------------------------ S6, S7
def append(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a table."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> int:
    """Truncate and reload; returns the number of rows cleared (0 for a
    new table), counted from the table before it is replaced."""
    spark = df.sparkSession
    cleared = spark.read.parquet(path).count() if path_exists(spark, path) else 0
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return cleared


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite);
    e.g. re-landing one season leaves every other season alone. The mode is
    an option of this write; the session's setting is not touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


# Spark's own limit on the buckets of a table.
MAX_BUCKETS = 100_000


class Buckets:
    """Tables dealt by one key into the same number of buckets: groupings on
    the key and joins among them do not shuffle their rows."""

    def __init__(self, spark: SparkSession, key: str, n: int):
        self.spark, self.key, self.n = spark, key, min(n, MAX_BUCKETS)
        self.names: dict[str, str] = {}

    def append(self, df: DataFrame, path: str) -> DataFrame:
        """S6 on a bucketed table at ``path``; returns the table. A task of
        rows that are dealt likewise writes one file."""
        name = self.names.setdefault(path, f"rinkspark_{uuid.uuid4().hex}")
        w = df.write.mode("append").bucketBy(self.n, self.key).option("path", path).option("compression", "zstd")
        w.saveAsTable(name, format="parquet")
        return self.spark.table(name)


@contextmanager
def bucketed(spark: SparkSession, key: str, n: int) -> Iterator[Buckets]:
    """Bucketed tables for the time of a ``with`` block: their names leave the
    catalogue at its end, the files stay, and what was read from them is still
    good."""
    tables = Buckets(spark, key, n)
    try:
        yield tables
    finally:
        for name in tables.names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# ---------------------------------------------------------------- S8, S9
def latest_per_key(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order_by`` (then by every other
    column, so the choice is deterministic). ``max(struct)`` aggregates
    map-side, so a hot key never lands whole in one task."""
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    best = F.max(F.struct(*[F.col(c) for c in order_by], *[F.col(c) for c in rest])).alias("_b")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in order_by + rest]).select(*df.columns)


def upsert(
    old: DataFrame,
    new: DataFrame,
    key: str | Sequence[str],
    *,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Last write wins per key. Rows of ``old`` whose key ``new`` holds
    are replaced; ``new`` is first reduced to one row per key (greatest by
    ``order_by``, e.g. a landing time, then by the remaining columns)."""
    keys = _keys(key)
    fresh = latest_per_key(new, keys, list(order_by))
    kept = old.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*old.columns))


def partial_upsert(
    old: DataFrame,
    new: DataFrame,
    key: str | Sequence[str],
    columns: Sequence[str],
    *,
    keep_when_null: Sequence[str] = (),
) -> DataFrame:
    """Only ``columns`` change. Full outer join on the key; a key only
    in ``new`` becomes a new row whose other columns are null; a key only in
    ``old`` keeps its row. Columns in ``keep_when_null`` change only where
    the new value is not null (the source row did not provide them). A key
    that ``new`` repeats is first reduced to its greatest row by ``columns``,
    so every key stays unique."""
    keys = _keys(key)
    o = old.alias("o")
    n = latest_per_key(new.select(*keys, *columns), keys, list(columns)).withColumn("_present", F.lit(True)).alias("n")
    j = o.join(n, keys, "full_outer")
    out_cols = []
    for c in old.columns:
        if c in keys:
            out_cols.append(F.col(c))
        elif c in columns and c in keep_when_null:
            out_cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c in columns:
            out_cols.append(F.when(F.col("n._present"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out_cols.append(F.col(f"o.{c}").alias(c))
    extra = [F.col(f"n.{c}").alias(c) for c in columns if c not in old.columns]
    return j.select(*out_cols, *extra)


# ------------------------------------------------------------- snapshots
def write_snapshot(df: DataFrame, root: str) -> str:
    """Write ``df`` as the next snapshot under ``root`` and record it.

    The previous snapshot stays readable (an upsert may read the current
    table and write the next one). Pointers are append-only: each snapshot
    adds one line (sequence, path) under ``_CURRENT`` and readers take the
    highest sequence, so no moment exists without a current snapshot."""
    spark = df.sparkSession
    seq = _current_pointer(spark, root)
    n = 0 if seq is None else seq[0] + 1
    path = f"{root}/snapshot={n}"
    df.write.mode("errorifexists").parquet(path)
    _write_pointer(spark, root, path, n)
    return path


def _current_pointer(spark: SparkSession, root: str) -> tuple[int, str] | None:
    if not path_exists(spark, f"{root}/_CURRENT"):
        return None
    # One short line per snapshot ever written; the max is a global agg.
    best = (
        spark.read.schema("seq long, path string")
        .option("sep", "\t")
        .csv(f"{root}/_CURRENT")
        .agg(F.max(F.struct("seq", "path")).alias("b"))
        .first()
    )
    if best is None or best.b is None:
        return None
    return int(best.b.seq), best.b.path


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    cur = _current_pointer(spark, root)
    return None if cur is None else cur[1]


def _write_pointer(spark: SparkSession, root: str, path: str, seq: int) -> None:
    rows = spark.createDataFrame([(seq, path)], "seq long, path string")
    rows.coalesce(1).write.mode("append").option("sep", "\t").csv(f"{root}/_CURRENT")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    path = current_snapshot(spark, root)
    if path is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return spark.read.parquet(path)


# ------------------------------------------------------------------- S11
def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """An empty frame with the declared schema of a table."""
    schema, _ = schemas.TABLES[name]
    return spark.createDataFrame([], schema)


def ensure_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Create every declared table that does not exist yet. A table
    whose folder exists is left alone, readable or not."""
    out = {}
    for name in schemas.TABLES:
        path = f"{root}/{name}"
        if not path_exists(spark, path):
            empty_table(spark, name).write.mode("errorifexists").parquet(path)
        out[name] = path
    return out


def contract_violations(df: DataFrame, key: str | Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """S11 as a quality job: one row with the number of surplus rows on
    duplicated keys, rows with a null key part and nulls per required
    column. One aggregation on the key (partial counts map-side), then a
    global sum over the per-key rows."""
    keys = _keys(key)
    key_null = F.lit(False)
    for k in keys:
        key_null = key_null | F.col(k).isNull()
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in not_null],
    )
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(key_null, F.col("_n"))), F.lit(0)).alias("null_keys"),
        *[F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(f"null_{c}") for c in not_null],
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast and order columns to a declared schema; missing columns are null
    (schema evolution with defaults)."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
