"""Helpers shared by the operators: table access, names that cannot clash,
working folders, and Arrow batches cut to a byte bound."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute, in the workers too
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import rinkspark

#: Text bytes handed to one numpy pass; a single longer text is one pass.
PASS_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, once
    per application. Nothing is done if it came as a file that Spark ships."""
    sc, home = spark.sparkContext, os.path.dirname(os.path.abspath(rinkspark.__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(home):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="rinkspark-package-"), f"rinkspark-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(home):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.join("rinkspark", os.path.relpath(full, home)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ref(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as a variable in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir``
    names. Without that setting a local session gets a temporary folder; on a
    cluster that is an error, as executors could not see it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="rinkspark-llm-")
    return os.path.join(shared, f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: it is not
    computed again, and lost executors cost no lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Longest text, in bytes, that a sample takes to the driver.
SAMPLE_TEXT_BYTES = 1 << 16


def spread_sample(docs: DataFrame, text_col: str, rows: int) -> list[str]:
    """Texts of about ``rows`` rows from all over the table (all, if it has no
    more), the same ones each time for the same partitions. At most twice as
    many reach the driver, of ``SAMPLE_TEXT_BYTES`` bytes at most each: longer
    texts and nulls are not taken. It scans the text column once."""
    share = min(1.0, rows / max(1, docs.count()))
    texts = docs.select(ref(docs, text_col).alias("t")).filter((F.octet_length("t") <= SAMPLE_TEXT_BYTES) & (F.rand(11) < share))
    return [t for (t,) in texts.limit(2 * rows).collect()]


class Buckets:
    """Tables bucketed by one key, so that joins on it do not shuffle them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def write(self, df: DataFrame, name: str, key: str) -> DataFrame:
        table = f"rinkspark_{name}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, key).option("path", work_dir(self.spark, name)).saveAsTable(table, format="parquet")
        self.names.append(table)
        return self.spark.table(table)


@contextmanager
def bucketed(spark: SparkSession) -> Iterator[Buckets]:
    """Bucketed tables for the time of a ``with`` block: their names leave the
    catalogue at its end (the files lie below the shared folder)."""
    tables = Buckets(spark)
    try:
        yield tables
    finally:
        for name in tables.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def pieces(batch: pa.RecordBatch, text: int, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold at most ``limit`` bytes
    (a single row may hold more)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and held + size > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    yield batch.slice(at, n - at)


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]],
    added: T.StructType,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns computed from one text column, without a shuffle.

    ``make()`` runs once per task and returns a function from an Arrow string
    array to one array per field of ``added``. ``keep`` names the columns
    passed through (all by default); ``added`` must not clash with them. A
    null text reaches the function as the empty text.
    """
    ship_package(df.sparkSession)
    kept = list(df.columns if keep is None else keep)
    at = df.columns.index(text_col) if keep is None else len(kept)
    source = df if keep is None else df.select(*[ref(df, c) for c in kept], ref(df, text_col).alias(free_name(df, "_text")))
    schema = T.StructType([source.schema[i] for i in range(len(kept))] + list(added.fields))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401 - makes pa.compute available in the worker

        fn = make()
        for whole in batches:
            for batch in pieces(whole, at):
                texts = pa.compute.fill_null(batch.column(at).cast(pa.string()), "")
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + list(fn(texts)), names)

    return source.mapInArrow(run, schema)
