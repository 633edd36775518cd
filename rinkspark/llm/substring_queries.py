"""Query op3: substring deduplication of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm.common import read_table
from rinkspark.llm.substring_dedup import with_repeats


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many passages went, the documents that hold
    them, and the text that stays."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out, spans, cut = with_repeats(docs)
    found = F.coalesce(F.col(spans), F.array().cast("array<struct<begin:int,end:int,holder:bigint,n_words:int>>"))
    return out.select(
        "doc_id",
        F.array_sort(F.array_distinct(F.transform(found, lambda s: s["holder"]))).alias("repeats_of"),
        F.transform(found, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))).alias("removed_bytes"),
        (F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.coalesce(cut, F.lit("")))).cast("long").alias("removed_chars"),
        F.col(cut).alias("text"),
    )
