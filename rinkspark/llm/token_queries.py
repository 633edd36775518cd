"""Queries op5 (token files) and op8 (token counts) over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm.bpe_queries import tokenizer_file
from rinkspark.llm.common import read_table
from rinkspark.llm.token_counts import with_token_counts
from rinkspark.llm.token_store import stored_tokens

END_ID = 1
MAX_TOKENS = 1024


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return stored_tokens(docs, tokenizer_file("word_bpe_49k.json"), END_ID).withColumnRenamed("crc32", "ids_crc32")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs, tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))
