"""Registered calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark import constants as K
from rinkspark.operators import calendar as C
from rinkspark.plans import standins as S
from rinkspark.plans.registry import register
from rinkspark.sources import landed as L

REMAINING_AS_OF = "1998-06-10"


def regular_games(spark, d):
    """Regular-season games only."""
    return L.regular_season(S.club_games(spark, d), K.REGULAR_SEASON_GAME_TYPE)


_TEAM_ROWS_SQL = """
g AS (SELECT * FROM club_games WHERE game_type = 2{extra}),
tg AS (
  SELECT game_id, start_time_utc, game_date, home_abbrev AS team, away_abbrev AS opponent, TRUE AS is_home FROM g
  UNION ALL
  SELECT game_id, start_time_utc, game_date, away_abbrev AS team, home_abbrev AS opponent, FALSE AS is_home FROM g
)"""


@register(
    "week_schedule",
    S.with_ctes(S.CLUB_GAMES_SQL, _TEAM_ROWS_SQL.format(extra=""))
    + """,
wk AS (SELECT *, strftime(game_date, '%G-W%V') AS week,
              CASE WHEN is_home THEN 'vs ' ELSE '@ ' END || opponent AS label FROM tg)
SELECT team, week,
       CAST(date_trunc('week', min(game_date)) AS DATE) AS monday_date,
       CAST(date_trunc('week', min(game_date)) AS DATE) + 6 AS sunday_date,
       CAST(count(*) AS INTEGER) AS game_count,
       string_agg(label, ', ' ORDER BY start_time_utc, game_id) AS opponents
FROM wk GROUP BY team, week""",
)
def week_schedule(spark, d):
    return C.weekly_schedule(regular_games(spark, d))


_WEEK_SQL = (
    S.with_ctes(S.CLUB_GAMES_SQL, _TEAM_ROWS_SQL.format(extra=""))
    + """,
wk AS (SELECT *, strftime(game_date, '%G-W%V') AS week,
              CASE WHEN is_home THEN 'vs ' ELSE '@ ' END || opponent AS label FROM tg),
sched AS (
  SELECT team, week,
         CAST(date_trunc('week', min(game_date)) AS DATE) AS monday_date,
         CAST(date_trunc('week', min(game_date)) AS DATE) + 6 AS sunday_date,
         CAST(count(*) AS INTEGER) AS game_count,
         string_agg(label, ', ' ORDER BY start_time_utc, game_id) AS opponents
  FROM wk GROUP BY team, week
)"""
)


@register(
    "week_schedule_table",
    _WEEK_SQL + "\nSELECT row_number() OVER (ORDER BY team, week) AS id, * FROM sched",
)
def week_schedule_table(spark, d):
    """The weekly rows as the team_schedule table, ids in (team, week) order."""
    return C.weekly_schedule_table(regular_games(spark, d))


@register(
    "remaining_games",
    S.with_ctes(
        S.CLUB_GAMES_SQL,
        _TEAM_ROWS_SQL.format(
            extra=f" AND game_date >= DATE '{REMAINING_AS_OF}'"
            f" AND game_date <= CAST(date_trunc('week', DATE '{REMAINING_AS_OF}') AS DATE) + 6"
        ),
    )
    + """,
per AS (
  SELECT team, CAST(count(*) AS INTEGER) AS n_games,
         string_agg(CASE WHEN is_home THEN 'vs ' ELSE '@ ' END || opponent || ' (' || strftime(game_date, '%Y-%m-%d') || ')',
                    ', ' ORDER BY game_date, start_time_utc, game_id) AS games
  FROM tg GROUP BY team
)
SELECT n.team, coalesce(per.n_games, 0) AS n_games, coalesce(per.games, '') AS games,
       CAST(date_trunc('week', DATE '"""
    + REMAINING_AS_OF
    + """') AS DATE) AS week_monday
FROM (SELECT DISTINCT 'T' || CAST(c_custkey // 10 AS VARCHAR) AS team FROM customer) n LEFT JOIN per ON per.team = n.team""",
)
def remaining_games(spark, d):
    teams = S.table(spark, d, "customer").select(S.club(F.col("c_custkey")).alias("team"))
    out = C.remaining_games(regular_games(spark, d), REMAINING_AS_OF, teams)
    monday, _ = C.week_frame(REMAINING_AS_OF)
    return out.select("team", "n_games", F.array_join("games", ", ").alias("games"), monday.alias("week_monday"))


COUNTS_AS_OF = "1999-03-01"


@register(
    "past_future_counts",
    S.with_ctes(S.GAMES_SQL)
    + f"""
SELECT count_if(game_date < DATE '{COUNTS_AS_OF}') AS n_past,
       count_if(game_date >= DATE '{COUNTS_AS_OF}') AS n_future, count_if(game_date IS NULL) AS n_undated
FROM games""",
)
def past_future_counts(spark, d):
    """C2's counts: past, future and undated games."""
    return C.past_future_counts(S.games(spark, d), COUNTS_AS_OF)


@register(
    "past_games",
    S.with_ctes(S.GAMES_SQL)
    + f"""
SELECT game_id, game_date FROM games WHERE game_date < DATE '{COUNTS_AS_OF}'""",
)
def past_games(spark, d):
    """All games before a date (in date order; the order is unit-tested)."""
    return C.past_games(S.games(spark, d), COUNTS_AS_OF).select("game_id", "game_date")


@register(
    "yesterday_games",
    S.with_ctes(S.GAMES_SQL) + f"SELECT game_id, game_type, game_date FROM games WHERE game_date = DATE '{COUNTS_AS_OF}' - INTERVAL 1 DAY",
)
def yesterday_games(spark, d):
    """C3."""
    return C.yesterday_games(S.games(spark, d), COUNTS_AS_OF).select("game_id", "game_type", "game_date")


@register("weekly_csv_roundtrip", _WEEK_SQL + "\nSELECT team, week, monday_date, sunday_date, game_count, opponents FROM sched")
def weekly_csv_roundtrip(spark, d):
    """The weekly schedule written as the CSV the source tool exchanges
    (Team, Week, Monday_Date, Sunday_Date, Game_Count, Opponents) under the
    shared checkpoint folder, then read back with the declared CSV reader."""
    from rinkspark.sources.landed import read_weekly_csv
    from rinkspark.streaming.totals import work_root

    path = f"{work_root(spark, 'weekly-csv')}/team_weekly_schedule"
    rows = C.weekly_schedule(regular_games(spark, d)).select(
        F.col("team").alias("Team"),
        F.col("week").alias("Week"),
        F.date_format("monday_date", "yyyy-MM-dd").alias("Monday_Date"),
        F.date_format("sunday_date", "yyyy-MM-dd").alias("Sunday_Date"),
        F.col("game_count").alias("Game_Count"),
        F.col("opponents").alias("Opponents"),
    )
    rows.write.option("header", True).csv(path)
    return read_weekly_csv(spark, path)
