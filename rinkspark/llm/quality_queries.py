"""Query op9: quality rules over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rinkspark.llm.common import read_table
from rinkspark.llm.quality_rules import quality_report


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(*) AS n
  FROM (SELECT DISTINCT doc_id, i + o AS p FROM twice, (VALUES (0), (1), (2)) AS x(o)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d
), m AS (
  SELECT d.doc_id, d.t, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AS base_failed,
       NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50
            OR n_symbols * 10 > n_words * 3 OR n_dup_lines * 10 > n_lines * 4
            OR len(regexp_extract_all(t, '[A-Z]')) * 2 > word_chars
            OR word_chars < n_words * 2 OR word_chars > n_words * 20) AS kept
FROM m
"""
