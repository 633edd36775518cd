"""Query op1: url filters over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rinkspark.llm.common import read_table
from rinkspark.llm.url_filter import judge_urls

#: The rules that the query is asked for.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
