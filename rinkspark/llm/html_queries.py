"""Query op6: main text of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rinkspark.llm.common import read_table
from rinkspark.llm.html_extract import extracted


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
