"""The corpus pipeline: quality rules, near-dedup, substring dedup, benchmark
decontamination, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet to the shared folder and reads it back as the
next stage's documents. All stages but the last return the columns of
``documents``. Order MinHash, chunk digests and BPE have no SQL form, so there is no
ORACLE_SQL; the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm.bpe_codec import encoded_and_decoded
from rinkspark.llm.bpe_queries import tokenizer_file
from rinkspark.llm.common import read_table, staged
from rinkspark.llm.decontamination import decontaminated
from rinkspark.llm.near_dedup import one_of_each
from rinkspark.llm.quality_rules import keep_good
from rinkspark.llm.substring_dedup import deduplicated

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the least id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in their first document only."""
    return deduplicated(docs, length_col="n_chars")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian 32-bit), and the text
    that the ids decode to."""
    tok = tokenizer_file(TOKENIZER)
    back = encoded_and_decoded(docs, tok, ["doc_id", "lang", "source"])
    return back.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("bpe", bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
