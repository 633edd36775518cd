"""Query op4: near-duplicate classes of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm.common import read_table
from rinkspark.llm.near_dedup import near_classes


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class and whether it is the one that stays."""
    classes = near_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
