"""Parametrised SQL over DataFrames.

The SQL text is planned by Catalyst like any DataFrame program; values are
bound as named parameters (``:name``), never pasted into the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, views: Mapping[str, DataFrame], args: Mapping[str, object] | None = None) -> DataFrame:
    """Run ``text`` over ``views`` with ``args`` bound to its ``:name``
    markers. Table names in the text are ``{view}`` placeholders; each call
    registers its views under fresh names, so concurrent calls in one
    session never see each other's views. The result is analysed at once,
    so the views are dropped again before returning."""
    tag = uuid.uuid4().hex[:10]
    names = {}
    for name, df in views.items():
        names[name] = f"{name}_{tag}"
        df.createOrReplaceTempView(names[name])
    try:
        out = spark.sql(text.format(**names), args=dict(args or {}))
    finally:
        for n in names.values():  # the analysed plan already holds the views
            spark.catalog.dropTempView(n)
    return out


# The hot list (Q-15) as one SQL statement with bound parameters.
HOT_LIST_TEXT = """
SELECT p.player_id, pl.player_name, pl.team_abbrev, pl.position,
       coalesce(ft.team_name, '*** Free Agent ***') AS fantasy_team,
       p.games_last_14, p.avg_fpts_last_14
FROM (
  SELECT player_id, count(game_id) AS games_last_14, avg(total_fpts) AS avg_fpts_last_14
  FROM {fact}
  WHERE game_date >= date_sub(:as_of, :days) AND season = :season
  GROUP BY player_id
  HAVING games_last_14 > :min_games
) p
JOIN {players} pl ON p.player_id = pl.player_id
LEFT JOIN {fantasy_team} ft ON pl.fantasy_team_id = ft.team_id
ORDER BY p.avg_fpts_last_14 DESC, p.player_id
LIMIT :top
"""
