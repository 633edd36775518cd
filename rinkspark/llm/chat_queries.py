"""Query op10: chat formatting over ``conversations``, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm.chat_format import formatted, masked_text, parsed_turns
from rinkspark.llm.common import read_table


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    out = formatted(turns.unionByName(planted))
    read = out.select(
        "conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), parsed_turns(F.col("formatted")).alias("t"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")
    )
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, row_number() OVER w AS n,
         CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens,
         length(role || text) + len(regexp_extract_all(role, k)) + len(regexp_extract_all(text, k)) AS chars,
         len(regexp_extract_all(role, k)) + length(role) AS role_chars
  FROM c, (SELECT '<\\*(\|im_start\|>|\|im_sep\|>|\|im_part\|>|\|im_end\|>|\|endoftext\|>|s>|/s>)|\[\\*(INST\]|/INST\])' AS k)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars - role_chars + CASE opens WHEN 1 THEN role_chars + 12 + 10 + 11 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
