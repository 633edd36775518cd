"""Query op7: BPE encoding and decoding of ``documents``."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm.bpe_codec import encoded_and_decoded
from rinkspark.llm.common import read_table


def tokenizer_file(name: str) -> str:
    """Content of a public tokenizer file, read on the driver."""
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokenizer_file("word_bpe_49k.json")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    back = encoded_and_decoded(docs, tok, ["doc_id"])
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
