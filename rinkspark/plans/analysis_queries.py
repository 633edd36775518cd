"""Registered analysis queries (Q-1..Q-15, L1-L9) over the stand-in views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkspark.functions.scoring import display_round
from rinkspark.operators import analysis as A
from rinkspark.plans import standins as S
from rinkspark.plans.registry import register
from rinkspark.session import cut_lineage

# Fixed report parameters of the registered queries.
EVENTS_AS_OF = "2024-01-31"
EVENTS_SEASON = "2024"
ORDERS_SEASON = "1998"
ORDERS_AS_OF = "2001-08-02"


from rinkspark.plans.rounding import TIE_BIAS, r4, rnd4  # noqa: E402,F401


# --------------------------------------------------------------- hot list
HOT_LIST_SQL = (
    S.with_ctes(S.EVENT_LINES_SQL, S.PLAYERS_SQL, S.FANTASY_TEAMS_SQL)
    + """,
per_player AS (
  SELECT player_id, count(game_id) AS games_last_14, avg(total_fpts) AS avg_fpts_last_14
  FROM event_lines
  WHERE game_date >= DATE '{as_of}' - INTERVAL 14 DAY AND season = '{season}'
  GROUP BY player_id
  HAVING count(game_id) > 2
)
SELECT p.player_id, pl.player_name, pl.team_abbrev, pl.position,
       coalesce(ft.team_name, '*** Free Agent ***') AS fantasy_team,
       p.games_last_14, round(p.avg_fpts_last_14, 4) AS avg_fpts_last_14
FROM per_player p
JOIN players pl ON p.player_id = pl.player_id
LEFT JOIN fantasy_teams ft ON pl.fantasy_team_id = ft.team_id
{where}
ORDER BY p.avg_fpts_last_14 DESC, p.player_id
LIMIT 100"""
)


def _hot(spark, d, free_agents_only):
    out = A.hot_list(
        S.event_lines(spark, d),
        S.players(spark, d),
        S.fantasy_teams(spark, d),
        EVENTS_AS_OF,
        season=EVENTS_SEASON,
        free_agents_only=free_agents_only,
    )
    return out.select(*[r4(c) if c == "avg_fpts_last_14" else c for c in out.columns])


@register(
    "hot_list",
    HOT_LIST_SQL.format(as_of=EVENTS_AS_OF, season=EVENTS_SEASON, where=""),
)
def hot_list(spark, d):
    return _hot(spark, d, False)


@register(
    "hot_list_free_agents",
    HOT_LIST_SQL.format(as_of=EVENTS_AS_OF, season=EVENTS_SEASON, where="WHERE pl.fantasy_team_id IS NULL"),
)
def hot_list_free_agents(spark, d):
    return _hot(spark, d, True)


# ----------------------------------------------------- opponent difficulty
def _tier_sql(rank):
    return f"CASE WHEN {rank} <= 10 THEN 'Easy' WHEN {rank} >= 23 THEN 'Hard' ELSE 'Average' END"


_DIFF_SQL = """
d AS (SELECT season, opponent_abbrev, avg(total_fpts) AS a FROM {src} GROUP BY season, opponent_abbrev),
r AS (
  SELECT season, opponent_abbrev, a,
         CAST(floor(rank() OVER (PARTITION BY season ORDER BY a DESC)
                    + (count(*) OVER (PARTITION BY season, a) - 1) / 2.0) AS INTEGER) AS rank
  FROM d
)
SELECT season, opponent_abbrev, round(a, 4) + 0.0 AS avg_fpts_allowed, rank, """ + _tier_sql("rank") + """ AS difficulty
FROM r"""


def _difficulty(fact):
    out = A.ranked_difficulty(fact, by=["season"])
    return out.select("season", "opponent_abbrev", r4("avg_fpts_allowed"), "rank", "difficulty")


@register("opponent_difficulty", S.with_ctes(S.SKATER_LINES_SQL) + "," + _DIFF_SQL.format(src="skater_lines"))
def opponent_difficulty(spark, d):
    return _difficulty(S.skater_lines(spark, d))


@register("opponent_difficulty_goalie", S.with_ctes(S.GOALIE_LINES_SQL) + "," + _DIFF_SQL.format(src="goalie_lines"))
def opponent_difficulty_goalie(spark, d):
    return _difficulty(S.goalie_lines(spark, d))


# ------------------------------------------------------------- baselines
@register(
    "baseline",
    S.with_ctes(S.SKATER_LINES_SQL, S.PLAYERS_SQL)
    + f"""
SELECT f.player_id, p.player_name, count(f.game_id) AS games_played,
       round(avg(f.total_fpts), 4) AS avg_fpts, round(avg(f.goals), 4) AS avg_g, round(avg(f.assists), 4) AS avg_a,
       round(avg(f.shots), 4) AS avg_sog, round(avg(f.toi_seconds) / 60.0, 4) AS avg_toi_min
FROM skater_lines f JOIN players p ON f.player_id = p.player_id
WHERE f.season = '{ORDERS_SEASON}' AND NOT p.is_goalie
GROUP BY f.player_id, p.player_name""",
)
def baseline(spark, d):
    skaters = S.players(spark, d).where(~F.col("is_goalie"))
    out = A.skater_baseline(S.skater_lines(spark, d), skaters, ORDERS_SEASON)
    return out.select(
        "player_id", "player_name", "games_played",
        *[r4(c) for c in ("avg_fpts", "avg_g", "avg_a", "avg_sog", "avg_toi_min")],
    )


@register(
    "goalie_baseline",
    S.with_ctes(S.GOALIE_LINES_SQL, S.PLAYERS_SQL)
    + f"""
SELECT f.player_id, p.player_name, count(f.game_id) AS games_played,
       round(avg(f.total_fpts), 4) + 0.0 AS avg_fpts, round(avg(f.saves), 4) AS avg_saves,
       round(avg(f.save_pct), 4) AS avg_save_pct, CAST(sum(f.wins) AS BIGINT) AS total_wins,
       CAST(sum(f.shutouts) AS BIGINT) AS total_shutouts
FROM goalie_lines f JOIN players p ON f.player_id = p.player_id
WHERE f.season = '{ORDERS_SEASON}' AND p.is_goalie
GROUP BY f.player_id, p.player_name""",
)
def goalie_baseline(spark, d):
    goalies = S.players(spark, d).where(F.col("is_goalie"))
    out = A.goalie_baseline(S.goalie_lines(spark, d), goalies, ORDERS_SEASON)
    return out.select(
        "player_id", "player_name", "games_played",
        *[r4(c) for c in ("avg_fpts", "avg_saves", "avg_save_pct")],
        "total_wins", "total_shutouts",
    )


@register(
    "peripheral_floor",
    S.with_ctes(S.SKATER_LINES_SQL)
    + f"""
SELECT player_id, round(avg(hits), 4) AS avg_hits, round(avg(blocked_shots), 4) AS avg_blocks,
       round(avg(hits) * 0.1 + avg(blocked_shots) * 0.5, 4) AS avg_peripheral_fpts
FROM skater_lines WHERE season = '{ORDERS_SEASON}' GROUP BY player_id""",
)
def peripheral_floor(spark, d):
    out = A.peripheral_floor(S.skater_lines(spark, d), ORDERS_SEASON)
    return out.select("player_id", r4("avg_hits"), r4("avg_blocks"), r4("avg_peripheral_fpts"))


# ----------------------------------------------------------- recent form
@register(
    "recent_form",
    S.with_ctes(S.EVENT_LINES_SQL)
    + f"""
SELECT player_id, count(game_id) AS games_last_14_days, round(avg(total_fpts), 4) AS avg_fpts_last_14_days
FROM event_lines
WHERE game_date >= DATE '{EVENTS_AS_OF}' - INTERVAL 14 DAY AND season = '{EVENTS_SEASON}'
GROUP BY player_id""",
)
def recent_form(spark, d):
    out = A.recent_form(S.event_lines(spark, d), EVENTS_AS_OF, season=EVENTS_SEASON)
    return out.select("player_id", "games_last_14_days", r4("avg_fpts_last_14_days"))


@register(
    "recent_form_goalie",
    S.with_ctes(S.GOALIE_LINES_SQL)
    + f"""
SELECT player_id, count(game_id) AS games_last_14_days, round(avg(total_fpts), 4) + 0.0 AS avg_fpts_last_14_days,
       round(avg(save_pct), 4) + 0.0 AS save_pct_last_14_days
FROM goalie_lines
WHERE game_date >= DATE '{ORDERS_AS_OF}' - INTERVAL 14 DAY AND season = '2001'
GROUP BY player_id""",
)
def recent_form_goalie(spark, d):
    out = A.recent_form(
        S.goalie_lines(spark, d), ORDERS_AS_OF, season="2001", extra_avgs={"save_pct": "save_pct_last_14_days"}
    )
    return out.select(
        "player_id", "games_last_14_days", r4("avg_fpts_last_14_days"), r4("save_pct_last_14_days")
    )


# ---------------------------------------------------- history vs opponent
@register(
    "history_vs_opponent",
    S.with_ctes(S.SKATER_LINES_SQL)
    + """
SELECT player_id, opponent_abbrev, count(game_id) AS games_against, round(avg(total_fpts), 4) AS avg_fpts_against
FROM skater_lines GROUP BY player_id, opponent_abbrev""",
)
def history_vs_opponent(spark, d):
    out = A.history_vs_opponent(S.skater_lines(spark, d))
    return out.select("player_id", "opponent_abbrev", "games_against", r4("avg_fpts_against"))


@register(
    "history_vs_opponent_goalie",
    S.with_ctes(S.GOALIE_LINES_SQL)
    + """
SELECT player_id, opponent_abbrev, count(game_id) AS games_against, round(avg(total_fpts), 4) + 0.0 AS avg_fpts_against,
       round(avg(save_pct), 4) + 0.0 AS avg_save_pct_against
FROM goalie_lines GROUP BY player_id, opponent_abbrev""",
)
def history_vs_opponent_goalie(spark, d):
    out = A.history_vs_opponent(S.goalie_lines(spark, d), extra_avgs={"save_pct": "avg_save_pct_against"})
    return out.select(
        "player_id", "opponent_abbrev", "games_against", r4("avg_fpts_against"), r4("avg_save_pct_against")
    )


# ---------------------------------------------------------- player report
REPORT_AS_OF = "1998-12-31"

_REPORT_PART_SQL = """
{kind}_hist AS (
  SELECT player_id, opponent_abbrev, count(game_id) AS g, avg(total_fpts) AS a FROM {src} GROUP BY player_id, opponent_abbrev
),
{kind}_part AS (
  SELECT p.player_id, p.player_name, p.is_goalie,
         b.games_played, round(b.avg_fpts, 4) + 0.0 AS avg_fpts,
         rf.games_last_14_days, round(rf.avg_fpts_last_14_days, 4) + 0.0 AS avg_fpts_last_14_days,
         h.n_opponents, h.best_opponent, round(h.best_avg_against, 4) + 0.0 AS best_avg_against
  FROM players p
  LEFT JOIN (SELECT player_id, count(game_id) AS games_played, avg(total_fpts) AS avg_fpts
             FROM {src} WHERE season = '{season}' GROUP BY player_id) b ON b.player_id = p.player_id
  LEFT JOIN (SELECT player_id, count(game_id) AS games_last_14_days, avg(total_fpts) AS avg_fpts_last_14_days
             FROM {src} WHERE season = '{season}' AND game_date >= DATE '{as_of}' - INTERVAL 14 DAY
             GROUP BY player_id) rf ON rf.player_id = p.player_id
  LEFT JOIN (SELECT player_id, count(*) AS n_opponents,
                    first(opponent_abbrev ORDER BY a DESC, opponent_abbrev DESC) AS best_opponent,
                    max(a) AS best_avg_against
             FROM {kind}_hist GROUP BY player_id) h ON h.player_id = p.player_id
  WHERE {goalie_pred}
)"""


@register(
    "player_report",
    S.with_ctes(S.SKATER_LINES_SQL, S.GOALIE_LINES_SQL, S.PLAYERS_SQL)
    + ","
    + _REPORT_PART_SQL.format(kind="sk", src="skater_lines", season=ORDERS_SEASON, as_of=REPORT_AS_OF, goalie_pred="NOT p.is_goalie")
    + ","
    + _REPORT_PART_SQL.format(kind="gk", src="goalie_lines", season=ORDERS_SEASON, as_of=REPORT_AS_OF, goalie_pred="p.is_goalie")
    + "\nSELECT * FROM sk_part UNION ALL SELECT * FROM gk_part",
)
def player_report(spark, d):
    players = S.players(spark, d).select("player_id", "player_name", "is_goalie")

    def part(fact, who):
        base = fact.where(F.col("season") == ORDERS_SEASON).groupBy("player_id").agg(
            F.count("game_id").alias("games_played"), F.avg("total_fpts").alias("avg_fpts")
        )
        recent = A.recent_form(fact, REPORT_AS_OF, season=ORDERS_SEASON)
        hist = A.history_vs_opponent(fact)
        rep = A.player_report(who, base, recent, hist)
        return rep.select(
            "player_id",
            "player_name",
            "is_goalie",
            "games_played",
            r4("avg_fpts"),
            "games_last_14_days",
            r4("avg_fpts_last_14_days"),
            F.size("history").cast("bigint").alias("n_opponents"),
            F.col("history")[0]["opponent_abbrev"].alias("best_opponent"),
            rnd4(F.col("history")[0]["avg_fpts_against"]).alias("best_avg_against"),
        )

    sk = part(S.skater_lines(spark, d), players.where(~F.col("is_goalie")))
    gk = part(S.goalie_lines(spark, d), players.where(F.col("is_goalie")))
    return sk.unionByName(gk)


# ------------------------------------------------------- matchup outlook
OUTLOOK_WEEK = "1998-W34"


_OUTLOOK_CTES = (
    S.with_ctes(S.SKATER_LINES_SQL, S.GOALIE_LINES_SQL, S.PLAYERS_SQL, S.CLUB_GAMES_SQL)
    + f""",
g AS (SELECT * FROM club_games WHERE game_type = 2),
tg AS (
  SELECT game_id, start_time_utc, game_date, home_abbrev AS team, 'vs ' || away_abbrev AS label FROM g
  UNION ALL
  SELECT game_id, start_time_utc, game_date, away_abbrev AS team, '@ ' || home_abbrev AS label FROM g
),
sched AS (
  SELECT team, strftime(game_date, '%G-W%V') AS week, CAST(count(*) AS INTEGER) AS game_count,
         string_agg(label, ', ' ORDER BY start_time_utc, game_id) AS opponents
  FROM tg GROUP BY team, strftime(game_date, '%G-W%V')
),
diff_raw AS (
  SELECT FALSE AS is_goalie, 'T' || CAST(player_id // 10 + 1 AS VARCHAR) AS opponent_abbrev, round(avg(total_fpts), 4) AS a FROM skater_lines WHERE season = '{ORDERS_SEASON}' GROUP BY 2
  UNION ALL
  SELECT TRUE AS is_goalie, 'T' || CAST(player_id // 10 + 1 AS VARCHAR) AS opponent_abbrev, round(avg(total_fpts), 4) AS a FROM goalie_lines WHERE season = '{ORDERS_SEASON}' GROUP BY 2
),
diff AS (
  SELECT is_goalie, opponent_abbrev, a,
         CAST(floor(rank() OVER (PARTITION BY is_goalie ORDER BY a DESC)
                    + (count(*) OVER (PARTITION BY is_goalie, a) - 1) / 2.0) AS INTEGER) AS rank
  FROM diff_raw
),
x AS (
  SELECT p.player_id, s.team AS team_abbrev, p.is_goalie, s.week, s.game_count,
         UNNEST(generate_series(0, len(string_split(s.opponents, ', ')) - 1)) AS slot, s.opponents
  FROM players p JOIN sched s ON s.team = 'T' || CAST(p.player_id // 10 AS VARCHAR) AND s.week = '{OUTLOOK_WEEK}'
),
y AS (SELECT *, string_split(opponents, ', ')[slot + 1] AS matchup FROM x)
"""
)


@register(
    "matchup_outlook",
    _OUTLOOK_CTES
    + f"""
SELECT y.player_id, y.team_abbrev, y.is_goalie, y.week, y.game_count, CAST(y.slot AS INTEGER) AS slot, y.matchup,
       string_split(y.matchup, ' ')[-1] AS opponent_abbrev, d.a + 0.0 AS avg_fpts_allowed, d.rank,
       CASE WHEN d.rank IS NULL THEN 'No difficulty data' ELSE {_tier_sql('d.rank')} END AS difficulty
FROM y LEFT JOIN diff d ON d.is_goalie = y.is_goalie AND d.opponent_abbrev = string_split(y.matchup, ' ')[-1]""",
)
def matchup_outlook(spark, d):
    """Q-6 over clubs: a club's week is a handful of games at any scale."""
    from rinkspark.operators.calendar import weekly_schedule
    from rinkspark.plans.calendar_queries import regular_games

    players = S.players(spark, d).select("player_id", S.club(F.col("player_id")).alias("team_abbrev"), "is_goalie")
    out = A.matchup_outlook(players, weekly_schedule(regular_games(spark, d)), _club_difficulty(spark, d), OUTLOOK_WEEK)
    return out.select(
        "player_id", "team_abbrev", "is_goalie", "week", "game_count", "slot", "matchup", "opponent_abbrev",
        "avg_fpts_allowed", "rank", "difficulty",
    )


def _club_difficulty(spark, d):
    def difficulty(lines, goalie):
        clubs = lines.withColumn("opponent_abbrev", S.club(F.col("player_id"), 1))
        # Rounded before ranking: equal averages must tie in any engine.
        return A.opponent_difficulty(clubs, ORDERS_SEASON).withColumn("avg_fpts_allowed", rnd4(F.col("avg_fpts_allowed"))).withColumn("is_goalie", F.lit(goalie))

    both = difficulty(S.skater_lines(spark, d), False).unionByName(difficulty(S.goalie_lines(spark, d), True))
    return A.average_rank(both, "avg_fpts_allowed", partition_by=["is_goalie"])


@register(
    "player_report_full",
    _OUTLOOK_CTES
    + f""",
m AS (
  SELECT y.player_id, string_agg(y.matchup || ' ' || coalesce(CAST(d.rank AS VARCHAR), '-') || ' '
           || CASE WHEN d.rank IS NULL THEN 'No difficulty data' ELSE {_tier_sql('d.rank')} END, ', ' ORDER BY y.slot) AS week
  FROM y LEFT JOIN diff d ON d.is_goalie = y.is_goalie AND d.opponent_abbrev = string_split(y.matchup, ' ')[-1]
  GROUP BY y.player_id
),
sb AS (
  SELECT player_id, count(game_id) AS games, avg(total_fpts) AS f, avg(goals) AS g, avg(shots) AS sog, avg(toi_seconds) / 60.0 AS toi,
         avg(hits) * 0.1 + avg(blocked_shots) * 0.5 AS floor_points
  FROM skater_lines WHERE season = '{ORDERS_SEASON}' GROUP BY player_id
),
gb AS (
  SELECT player_id, count(game_id) AS games, avg(total_fpts) AS f, avg(saves) AS saves, CAST(sum(wins) AS BIGINT) AS wins
  FROM goalie_lines WHERE season = '{ORDERS_SEASON}' GROUP BY player_id
),
rc AS (
  SELECT FALSE AS is_goalie, player_id, count(game_id) AS games, avg(total_fpts) AS f, CAST(NULL AS DOUBLE) AS pct
  FROM skater_lines WHERE season = '{ORDERS_SEASON}' AND game_date >= DATE '{REPORT_AS_OF}' - INTERVAL 14 DAY GROUP BY player_id
  UNION ALL
  SELECT TRUE, player_id, count(game_id), avg(total_fpts), avg(save_pct)
  FROM goalie_lines WHERE season = '{ORDERS_SEASON}' AND game_date >= DATE '{REPORT_AS_OF}' - INTERVAL 14 DAY GROUP BY player_id
),
hs AS (
  SELECT is_goalie, player_id, count(*) AS n, first(opponent_abbrev ORDER BY a DESC, opponent_abbrev DESC) AS best, CAST(sum(c) AS BIGINT) AS games
  FROM (SELECT FALSE AS is_goalie, player_id, opponent_abbrev, avg(total_fpts) AS a, count(game_id) AS c FROM skater_lines GROUP BY ALL
        UNION ALL SELECT TRUE, player_id, opponent_abbrev, avg(total_fpts), count(game_id) FROM goalie_lines GROUP BY ALL)
  GROUP BY is_goalie, player_id
)
SELECT p.player_id, p.player_name, p.is_goalie, m.week,
       coalesce(sb.games, gb.games) AS games_played, round(coalesce(sb.f, gb.f), 4) + 0.0 AS avg_fpts, round(sb.g, 4) AS avg_g,
       round(sb.sog, 4) AS avg_sog, round(sb.toi, 4) AS avg_toi_min, round(sb.floor_points, 4) AS floor_points,
       round(gb.saves, 4) AS avg_saves, gb.wins AS total_wins,
       rc.games AS recent_games, round(rc.f, 4) + 0.0 AS recent_fpts, round(rc.pct, 4) AS recent_save_pct,
       hs.n AS n_opponents, hs.games AS history_games
FROM players p LEFT JOIN m ON m.player_id = p.player_id
LEFT JOIN sb ON sb.player_id = p.player_id AND NOT p.is_goalie LEFT JOIN gb ON gb.player_id = p.player_id AND p.is_goalie
LEFT JOIN rc ON rc.player_id = p.player_id AND rc.is_goalie = p.is_goalie
LEFT JOIN hs ON hs.player_id = p.player_id AND hs.is_goalie = p.is_goalie""",
)
def player_report_full(spark, d):
    """Q-14 with all its parts (Q-1..Q-14) for every player."""
    from rinkspark.operators.calendar import weekly_schedule
    from rinkspark.plans.calendar_queries import regular_games

    players = S.players(spark, d).select("player_id", "player_name", S.club(F.col("player_id")).alias("team_abbrev"), "is_goalie")
    out = A.full_report(
        players, S.skater_lines(spark, d), S.goalie_lines(spark, d), weekly_schedule(regular_games(spark, d)), OUTLOOK_WEEK, REPORT_AS_OF, ORDERS_SEASON,
        difficulty=_club_difficulty(spark, d),
    )
    game = lambda g: F.concat_ws(" ", g["matchup"], F.coalesce(g["rank"].cast("string"), F.lit("-")), g["difficulty"])
    sb, gb, recent = (F.col(c) for c in ("skater_baseline", "goalie_baseline", "recent"))
    return out.select(
        "player_id",
        "player_name",
        "is_goalie",
        F.array_join(F.transform("week", game), ", ").alias("week"),
        F.coalesce(sb["games_played"], gb["games_played"]).alias("games_played"),
        rnd4(F.coalesce(sb["avg_fpts"], gb["avg_fpts"])).alias("avg_fpts"),
        rnd4(sb["avg_g"]).alias("avg_g"),
        rnd4(sb["avg_sog"]).alias("avg_sog"),
        rnd4(sb["avg_toi_min"]).alias("avg_toi_min"),
        rnd4(F.col("floor")["avg_peripheral_fpts"]).alias("floor_points"),
        rnd4(gb["avg_saves"]).alias("avg_saves"),
        gb["total_wins"].cast("bigint").alias("total_wins"),
        recent["games_last_14_days"].alias("recent_games"),
        rnd4(recent["avg_fpts_last_14_days"]).alias("recent_fpts"),
        rnd4(recent["avg_save_pct_last_14_days"]).alias("recent_save_pct"),
        F.when(F.col("history").isNotNull(), F.size("history")).cast("bigint").alias("n_opponents"),
        F.aggregate("history", F.lit(0).cast("bigint"), lambda x, h: x + h["games_against"]).alias("history_games"),
    )


# ---------------------------------------------------------------- lookups
LOOKUP_PLAYER = 7
LOOKUP_TEAM = 3
LOOKUP_DATE = "1998-06-10"


@register(
    "lookups",
    S.with_ctes(S.PLAYERS_SQL, S.FANTASY_TEAMS_SQL, S.SKATER_LINES_SQL, S.GOALIE_LINES_SQL)
    + f"""
SELECT 'player_by_id' AS kind, player_id AS id, player_name AS label, CAST(NULL AS DOUBLE) AS value FROM players WHERE player_id = {LOOKUP_PLAYER}
UNION ALL SELECT 'free_agent', player_id, player_name, NULL FROM players WHERE fantasy_team_id IS NULL
UNION ALL SELECT 'team_by_name', team_id, team_name, NULL FROM fantasy_teams WHERE team_name = 'NATION_{LOOKUP_TEAM}'
UNION ALL SELECT 'roster', player_id, player_name, NULL FROM players WHERE fantasy_team_id = {LOOKUP_TEAM}
UNION ALL SELECT 'skater_log', game_id, CAST(game_date AS VARCHAR), total_fpts FROM skater_lines WHERE player_id = {LOOKUP_PLAYER}
UNION ALL SELECT 'goalie_log', game_id, CAST(game_date AS VARCHAR), total_fpts FROM goalie_lines WHERE player_id = {LOOKUP_PLAYER}
UNION ALL SELECT 'date_skater', game_id, CAST(player_id AS VARCHAR), total_fpts FROM skater_lines WHERE game_date = DATE '{LOOKUP_DATE}'
UNION ALL SELECT 'date_goalie', game_id, CAST(player_id AS VARCHAR), total_fpts FROM goalie_lines WHERE game_date = DATE '{LOOKUP_DATE}'
UNION ALL SELECT 'teams_by_name', team_id, team_name, NULL FROM fantasy_teams""",
)
def lookups(spark, d):
    players = S.players(spark, d)
    teams = S.fantasy_teams(spark, d)
    sk = S.skater_lines(spark, d)
    gk = S.goalie_lines(spark, d)

    def shape(df, kind, id_col, label, value=None):
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(id_col).cast("bigint").alias("id"),
            F.col(label).cast("string").alias("label"),
            (F.col(value) if value else F.lit(None)).cast("double").alias("value"),
        )

    on_date = A.stats_on_date(sk, gk, LOOKUP_DATE)
    parts = [
        shape(A.player_by_id(players, LOOKUP_PLAYER), "player_by_id", "player_id", "player_name"),
        shape(A.free_agents(players), "free_agent", "player_id", "player_name"),
        shape(A.team_by_name(teams, f"NATION_{LOOKUP_TEAM}"), "team_by_name", "team_id", "team_name"),
        shape(A.roster_of(players, LOOKUP_TEAM), "roster", "player_id", "player_name"),
        shape(A.game_log(sk, LOOKUP_PLAYER), "skater_log", "game_id", "game_date", "total_fpts"),
        shape(A.game_log(gk, LOOKUP_PLAYER), "goalie_log", "game_id", "game_date", "total_fpts"),
        on_date.select(
            F.concat(F.lit("date_"), F.col("kind")).alias("kind"),
            F.col("game_id").cast("bigint").alias("id"),
            F.col("player_id").cast("string").alias("label"),
            F.col("total_fpts").cast("double").alias("value"),
        ),
        shape(A.teams_by_name(teams), "teams_by_name", "team_id", "team_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_position(df):
    """Adds ``position``, the 1-based place of each row in the frame's order:
    the place within its partition plus the rows of the partitions before (a
    window over one row per partition), so no task holds the whole result. The
    partitions are fixed by a reliable checkpoint."""
    low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = rows.join(offsets, "_part").withColumn("position", (F.col("_off") + low + 1).cast("bigint"))
    return out.drop("_id", "_part", "_off")


@register(
    "lookup_order",
    S.with_ctes(S.PLAYERS_SQL, S.FANTASY_TEAMS_SQL, S.SKATER_LINES_SQL, S.GOALIE_LINES_SQL)
    + f"""
SELECT 'roster' AS kind, row_number() OVER (ORDER BY player_name, player_id) AS position, player_id AS id FROM players WHERE fantasy_team_id = {LOOKUP_TEAM}
UNION ALL SELECT 'skater_log', row_number() OVER (ORDER BY game_date DESC, game_id DESC), game_id FROM skater_lines WHERE player_id = {LOOKUP_PLAYER}
UNION ALL SELECT 'goalie_log', row_number() OVER (ORDER BY game_date DESC, game_id DESC), game_id FROM goalie_lines WHERE player_id = {LOOKUP_PLAYER}
UNION ALL SELECT 'teams_by_name', row_number() OVER (ORDER BY team_name, team_id), team_id FROM fantasy_teams""",
)
def lookup_order(spark, d):
    """The order of the rows, as their place in it."""
    parts = {
        "roster": (A.roster_of(S.players(spark, d), LOOKUP_TEAM), "player_id"),
        "skater_log": (A.game_log(S.skater_lines(spark, d), LOOKUP_PLAYER), "game_id"),
        "goalie_log": (A.game_log(S.goalie_lines(spark, d), LOOKUP_PLAYER), "game_id"),
        "teams_by_name": (A.teams_by_name(S.fantasy_teams(spark, d)), "team_id"),
    }
    rows = [with_position(df.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"))) for kind, (df, key) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@register(
    "team_week",
    _OUTLOOK_CTES + f"SELECT team, week, game_count, opponents FROM sched WHERE week = '{OUTLOOK_WEEK}'",
)
def team_week(spark, d):
    """Q-5 for every team of a week."""
    from rinkspark.operators.calendar import weekly_schedule
    from rinkspark.plans.calendar_queries import regular_games

    sched = weekly_schedule(regular_games(spark, d))
    return A.team_week(sched, F.col("team"), OUTLOOK_WEEK).select("team", "week", "game_count", "opponents")


@register(
    "baseline_display",
    S.with_ctes(S.SKATER_LINES_SQL, S.PLAYERS_SQL)
    + f"""
SELECT f.player_id, round(avg(f.total_fpts) + {TIE_BIAS}, 2) AS avg_fpts, round(avg(f.goals) + {TIE_BIAS}, 2) AS avg_g,
       round(avg(f.toi_seconds) / 60.0 + {TIE_BIAS}, 1) AS avg_toi_min
FROM skater_lines f JOIN players p ON f.player_id = p.player_id
WHERE f.season = '{ORDERS_SEASON}' AND NOT p.is_goalie
GROUP BY f.player_id""",
)
def baseline_display(spark, d):
    """the baseline rounded for display, at the edge only."""
    skaters = S.players(spark, d).where(~F.col("is_goalie"))
    out = A.skater_baseline(S.skater_lines(spark, d), skaters, ORDERS_SEASON)
    shown = lambda c, n=2: display_round(F.col(c) + F.lit(TIE_BIAS), n).alias(c)
    return out.select("player_id", shown("avg_fpts"), shown("avg_g"), shown("avg_toi_min", 1))


# ------------------------------------------------------------ name search
SEARCH_TERM = "Red"


@register(
    "name_search",
    f"""
SELECT p_partkey, p_name, 'contains' AS mode FROM part WHERE contains(lower(p_name), lower('{SEARCH_TERM}'))
UNION ALL
SELECT p_partkey, p_name, 'like' AS mode FROM part WHERE lower(p_name) LIKE '%' || lower('r_d') || '%'""",
)
def name_search(spark, d):
    parts = S.table(spark, d, "part")
    a = A.search_players(parts, SEARCH_TERM, name_col="p_name").select("p_partkey", "p_name", F.lit("contains").alias("mode"))
    b = A.search_players(parts, "r_d", name_col="p_name", wildcards=True).select(
        "p_partkey", "p_name", F.lit("like").alias("mode")
    )
    return a.unionByName(b)


@register(
    "name_search_batch",
    """
WITH terms AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS term FROM part)
SELECT t.term, p.p_partkey FROM part p JOIN terms t ON contains(lower(p.p_name), lower(t.term))""",
)
def name_search_batch(spark, d):
    parts = S.table(spark, d, "part")
    terms = parts.select(F.element_at(F.split("p_name", " "), -1).alias("term")).distinct()
    return A.search_many(parts, terms, name_col="p_name").select("term", "p_partkey")


@register(
    "name_search_grams",
    """
WITH words AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS w FROM part),
terms AS (SELECT w AS term FROM words UNION SELECT substring(w, 1, 2) FROM words)
SELECT t.term, p.p_partkey FROM part p JOIN terms t ON contains(lower(p.p_name), lower(t.term))""",
)
def name_search_grams(spark, d):
    """L8 for a term list too long to broadcast: equi-joins on pieces, with
    terms of two letters among them."""
    parts = S.table(spark, d, "part")
    words = parts.select(F.element_at(F.split("p_name", " "), -1).alias("w")).distinct()
    terms = words.select(F.explode(F.array("w", F.substring("w", 1, 2))).alias("term")).distinct()
    return A.search_many(parts, terms, name_col="p_name", max_broadcast_terms=0).select("term", "p_partkey")


# ------------------------------------------------------- S5: SQL with args
@register(
    "hot_list_sql",
    HOT_LIST_SQL.format(as_of=EVENTS_AS_OF, season=EVENTS_SEASON, where=""),
)
def hot_list_sql(spark, d):
    import datetime as dt

    from rinkspark.sources.sql import HOT_LIST_TEXT, run_sql

    views = {
        "fact": S.event_lines(spark, d),
        "players": S.players(spark, d),
        "fantasy_team": S.fantasy_teams(spark, d),
    }
    args = {
        "as_of": dt.date.fromisoformat(EVENTS_AS_OF),
        "days": 14,
        "season": EVENTS_SEASON,
        "min_games": 2,
        "top": 100,
    }
    out = run_sql(spark, HOT_LIST_TEXT, views, args)
    return out.select(*[r4(c) if c == "avg_fpts_last_14" else c for c in out.columns])
