"""Query op11: phrase collocations of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rinkspark.llm.common import read_table
from rinkspark.llm.phrase_mining import collocations


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), total AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cut AS (
  SELECT x.lang, x.phrase, x.a, x.j, l.a AS l, r.a AS r, t.n, (1000 * x.a * t.n) // (l.a * r.a) AS score
  FROM (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM c) x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.j], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.j + 1:x.k], ' ')
  JOIN total t ON t.lang = x.lang
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase
  FROM c s JOIN (SELECT lang, a, k, w, unnest(range(2, k)) AS m FROM c) y ON y.lang = s.lang AND y.m = s.k AND 100 * y.a >= 100 * s.a
  WHERE contains(' ' || array_to_string(y.w, ' ') || ' ', ' ' || s.phrase || ' ')
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS BIGINT) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best ANTI JOIN inside USING (lang, phrase)
QUALIFY rank <= 2000
"""
