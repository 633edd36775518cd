"""Registered player-dimension queries (A1-A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark import constants as K
from rinkspark.operators import dimension as D
from rinkspark.plans import standins as S
from rinkspark.plans.registry import register

SEASON = "1998"
PRIOR_SEASON = "1997"
SPLIT_DATE = "1998-07-01"
ROSTER_TEAM = 3


from rinkspark.plans.rounding import r4, rnd4  # noqa: E402,F401


def goalie_players_lines(spark, d):
    """Goalie lines of the players whose position is goalie."""
    goalies = S.players(spark, d).where(F.col("is_goalie")).select("player_id")
    return S.goalie_lines(spark, d).join(goalies, "player_id", "left_semi")


_GOALIE_PLAYERS_LINES_SQL = """
gl AS (SELECT * FROM goalie_lines WHERE player_id IN (SELECT player_id FROM players WHERE is_goalie))"""


# ------------------------------------------------------------ A1, A2
@register(
    "latest_info",
    S.with_ctes(S.GOALIE_LINES_SQL)
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS rn FROM goalie_lines)
SELECT player_id, game_date AS latest_game_date, game_id AS latest_game_id, team_abbrev, 'Goalie' AS position, TRUE AS is_goalie
FROM r WHERE rn = 1""",
)
def latest_info(spark, d):
    out = D.latest_info(S.goalie_lines(spark, d), position_label=K.GOALIE_LABEL, is_goalie=True)
    return out.select("player_id", "latest_game_date", "latest_game_id", "team_abbrev", "position", "is_goalie")


@register(
    "latest_info_skater",
    S.with_ctes(S.SKATER_LINES_SQL)
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY player_id
        ORDER BY game_date DESC, game_id DESC, position DESC, jersey_number DESC) AS rn FROM skater_lines)
SELECT player_id, game_date AS latest_game_date, game_id AS latest_game_id, position, jersey_number
FROM r WHERE rn = 1""",
)
def latest_info_skater(spark, d):
    out = D.latest_info(S.skater_lines(spark, d))
    return out.select("player_id", "latest_game_date", "latest_game_id", "position", "jersey_number")


# ------------------------------------------------------------------ A3
@register(
    "union_precedence",
    """
WITH g AS (SELECT s_suppkey AS player_id, s_name AS player_name, 'Goalie' AS position, TRUE AS is_goalie FROM supplier),
k AS (SELECT c_custkey AS player_id, c_name AS player_name, substring(c_mktsegment, 1, 1) AS position, FALSE AS is_goalie FROM customer)
SELECT * FROM g
UNION ALL
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.player_id = k.player_id)""",
)
def union_precedence(spark, d):
    g = S.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("player_id"),
        F.col("s_name").alias("player_name"),
        F.lit(K.GOALIE_LABEL).alias("position"),
        F.lit(True).alias("is_goalie"),
    )
    k = S.table(spark, d, "customer").select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("player_name"),
        F.substring("c_mktsegment", 1, 1).alias("position"),
        F.lit(False).alias("is_goalie"),
    )
    return D.union_with_precedence(g, k)


# -------------------------------------------------------------- A4, A5
_SKATER_TOTALS_SQL = """
SELECT player_id, CAST(count(game_id) AS INTEGER) AS season_games_played, round(sum(total_fpts), 4) + 0.0 AS season_total_fpts,
       CAST(sum(goals) AS BIGINT) AS season_goals, CAST(sum(assists) AS BIGINT) AS season_assists,
       round(sum(pp_points), 4) + 0.0 AS season_pp_points, round(sum(sh_points), 4) + 0.0 AS season_sh_points,
       CAST(sum(shots) AS BIGINT) AS season_shots, CAST(sum(blocked_shots) AS BIGINT) AS season_blocked_shots,
       CAST(sum(hits) AS BIGINT) AS season_hits
FROM skater_lines WHERE season = '{season}' GROUP BY player_id"""


def _skater_totals_out(df):
    return df.select(
        "player_id", "season_games_played", r4("season_total_fpts"), "season_goals", "season_assists",
        r4("season_pp_points"), r4("season_sh_points"), "season_shots", "season_blocked_shots", "season_hits",
    )


@register("season_totals", S.with_ctes(S.SKATER_LINES_SQL) + _SKATER_TOTALS_SQL.format(season=SEASON))
def season_totals(spark, d):
    return _skater_totals_out(D.skater_season_totals(S.skater_lines(spark, d), SEASON))


@register(
    "goalie_season_totals",
    S.with_ctes(S.GOALIE_LINES_SQL)
    + f"""
SELECT player_id, CAST(count(game_id) AS INTEGER) AS season_games_played, round(sum(total_fpts), 4) + 0.0 AS season_total_fpts,
       CAST(sum(wins) AS BIGINT) AS season_wins, CAST(sum(shutouts) AS BIGINT) AS season_shutouts,
       CAST(sum(ot_losses) AS BIGINT) AS season_ot_losses, CAST(sum(saves) AS BIGINT) AS season_saves,
       CAST(sum(goals_against) AS BIGINT) AS season_goals_against
FROM goalie_lines WHERE season = '{SEASON}' GROUP BY player_id""",
)
def goalie_season_totals(spark, d):
    out = D.goalie_season_totals(S.goalie_lines(spark, d), SEASON)
    return out.select(
        "player_id", "season_games_played", r4("season_total_fpts"), "season_wins", "season_shutouts",
        "season_ot_losses", "season_saves", "season_goals_against",
    )


# ------------------------------------------------------------------ A7
@register("incremental_totals", S.with_ctes(S.SKATER_LINES_SQL) + _SKATER_TOTALS_SQL.format(season=SEASON))
def incremental_totals(spark, d):
    """Totals up to a split date, then the batch after it applied twice:
    the result must equal the full-season totals (idempotent increments)."""
    lines = S.skater_lines(spark, d).where(F.col("season") == SEASON)
    before = D.skater_season_totals(lines.where(F.col("game_date") < F.lit(SPLIT_DATE).cast("date")))
    batch = lines.where(F.col("game_date") >= F.lit(SPLIT_DATE).cast("date"))
    once = D.incremental_totals(before, lines, batch)
    twice = D.incremental_totals(once, lines, batch)
    return _skater_totals_out(twice)


@register("delta_totals", S.with_ctes(S.SKATER_LINES_SQL) + _SKATER_TOTALS_SQL.format(season=SEASON))
def delta_totals(spark, d):
    """A7 by deltas: totals of the lines before the split date, moved by a
    batch of every line from the split on plus a re-landed copy of the
    month before it (whose stored rows it replaces). Must equal the full
    season totals."""
    lines = S.skater_lines(spark, d).where(F.col("season") == SEASON)
    split = F.lit(SPLIT_DATE).cast("date")
    stored = lines.where(F.col("game_date") < split)
    relanded = stored.where(F.col("game_date") >= F.add_months(split, -1))
    fresh = lines.where(F.col("game_date") >= split).unionByName(relanded)
    out = D.delta_totals(D.skater_season_totals(stored), fresh, relanded)
    return _skater_totals_out(out)


# ------------------------------------------------------------------ A8
@register(
    "prior_season_averages",
    S.with_ctes(S.SKATER_LINES_SQL, S.GOALIE_LINES_SQL, S.PLAYERS_SQL, _GOALIE_PLAYERS_LINES_SQL)
    + f""",
gk AS (SELECT player_id, CAST(count(game_id) AS INTEGER) AS g, avg(total_fpts) AS a FROM gl WHERE season = '{PRIOR_SEASON}' GROUP BY player_id),
sk AS (SELECT player_id, CAST(count(game_id) AS INTEGER) AS g, avg(total_fpts) AS a FROM skater_lines WHERE season = '{PRIOR_SEASON}' GROUP BY player_id),
both_ AS (SELECT * FROM gk UNION ALL SELECT * FROM sk WHERE player_id NOT IN (SELECT player_id FROM gk)),
dim AS (SELECT player_id FROM players WHERE acctbal >= 0)
SELECT dim.player_id, both_.g AS prior_season_games_played, round(both_.a, 4) + 0.0 AS prior_season_avg_fpts
FROM dim LEFT JOIN both_ ON dim.player_id = both_.player_id""",
)
def prior_season_averages(spark, d):
    dim = (
        S.players(spark, d)
        .where(F.col("acctbal") >= 0)
        .select(
            "player_id",
            F.lit(None).cast("int").alias("prior_season_games_played"),
            F.lit(None).cast("double").alias("prior_season_avg_fpts"),
        )
    )
    out = D.prior_season_averages(dim, S.skater_lines(spark, d), goalie_players_lines(spark, d), PRIOR_SEASON)
    return out.select("player_id", "prior_season_games_played", r4("prior_season_avg_fpts"))


# -------------------------------------------------------------- A9, A10
@register(
    "roster_counts",
    S.with_ctes(S.PLAYERS_SQL, S.FANTASY_TEAMS_SQL)
    + """
SELECT t.team_id, t.team_name, t.owner_name, count(p.player_id) AS n_players
FROM fantasy_teams t LEFT JOIN players p ON p.fantasy_team_id = t.team_id
GROUP BY t.team_id, t.team_name, t.owner_name""",
)
def roster_counts(spark, d):
    return D.roster_counts(S.fantasy_teams(spark, d), S.players(spark, d))


@register("roster_count", S.with_ctes(S.PLAYERS_SQL) + f"SELECT count(*) AS n_players FROM players WHERE fantasy_team_id = {ROSTER_TEAM}")
def roster_count(spark, d):
    return D.roster_count(S.players(spark, d), ROSTER_TEAM)


# ------------------------------------------------------------------ A6
@register(
    "dimension_rebuild",
    S.with_ctes(S.SKATER_LINES_SQL, S.GOALIE_LINES_SQL, S.PLAYERS_SQL, _GOALIE_PLAYERS_LINES_SQL)
    + f""",
gk AS (
  SELECT player_id, team_abbrev, 'Goalie' AS position, TRUE AS is_goalie,
         CAST(count(*) OVER (PARTITION BY player_id) AS INTEGER) AS season_games_played,
         sum(total_fpts) OVER (PARTITION BY player_id) AS season_total_fpts,
         CAST(NULL AS BIGINT) AS season_goals,
         CAST(sum(wins) OVER (PARTITION BY player_id) AS BIGINT) AS season_wins,
         row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS rn
  FROM gl WHERE season = '{SEASON}'
),
sk AS (
  SELECT player_id, NULL AS team_abbrev, position, FALSE AS is_goalie,
         CAST(count(*) OVER (PARTITION BY player_id) AS INTEGER) AS season_games_played,
         sum(total_fpts) OVER (PARTITION BY player_id) AS season_total_fpts,
         CAST(sum(goals) OVER (PARTITION BY player_id) AS BIGINT) AS season_goals,
         CAST(NULL AS BIGINT) AS season_wins,
         row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC, position DESC, jersey_number DESC) AS rn
  FROM skater_lines WHERE season = '{SEASON}'
),
snap AS (
  SELECT * FROM gk WHERE rn = 1
  UNION ALL
  SELECT * FROM sk WHERE rn = 1 AND player_id NOT IN (SELECT player_id FROM gk)
)
SELECT p.player_id, p.player_name,
       CASE WHEN s.player_id IS NOT NULL AND s.is_goalie THEN s.team_abbrev ELSE p.team_abbrev END AS team_abbrev,
       coalesce(s.position, p.position) AS position,
       coalesce(s.is_goalie, p.is_goalie) AS is_goalie,
       p.fantasy_team_id, s.season_games_played, round(s.season_total_fpts, 4) + 0.0 AS season_total_fpts,
       s.season_goals, s.season_wins
FROM players p LEFT JOIN snap s ON s.player_id = p.player_id""",
)
def dimension_rebuild(spark, d):
    dim = S.players(spark, d).select(
        "player_id", "player_name", "team_abbrev", "position", "is_goalie", "fantasy_team_id",
        F.lit(None).cast("int").alias("season_games_played"),
        F.lit(None).cast("double").alias("season_total_fpts"),
        F.lit(None).cast("bigint").alias("season_goals"),
        F.lit(None).cast("bigint").alias("season_wins"),
    )
    out = D.rebuild_dimension(dim, S.skater_lines(spark, d), goalie_players_lines(spark, d), SEASON)
    return out.select(
        "player_id", "player_name", "team_abbrev", "position", "is_goalie", "fantasy_team_id",
        "season_games_played", r4("season_total_fpts"), "season_goals", "season_wins",
    )
