"""Query op13: personal data of ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm.common import read_table
from rinkspark.llm.private_data import KINDS, spelled, with_private


def n_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans; ``n_added`` is what the
    patterns add."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out, base, spans = with_private(docs, keep=["doc_id"])
    counts = [n_of(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(spelled(F.col(base)).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col(spans)).alias("spans"),
        (F.size(spans) - F.size(base)).cast("long").alias("n_added"),
    )
