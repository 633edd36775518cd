"""Registered roster-move queries (R2-R4) over events as a move log.

Moves: ``signup`` = add the user to the team after their nation's,
``click`` = drop the user from their nation's team, ``purchase`` = trade
the user for the next customer id with that customer's team. Other event
types are not moves. Move time = event time, move id = event id; some ids are
missing or those of another move, and some moves name a team that does not
exist (25). The oracle makes the moves one by one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.operators import roster as R
from rinkspark.plans import standins as S
from rinkspark.plans.registry import register


def moves(spark, d):
    e = S.table(spark, d, "events").where(F.col("event_type").isin("signup", "click", "purchase"))
    c = S.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    pc = c.select(F.col("c_custkey").alias("partner"), F.col("c_nationkey").alias("partner_nation"))
    m = e.join(c, e.user_id == c.c_custkey, "inner").withColumn("partner", F.col("user_id") + 1)
    m = m.join(pc, "partner", "left")
    kind = (
        F.when(F.col("event_type") == "signup", "add")
        .when(F.col("event_type") == "click", "drop")
        .otherwise("trade")
    )
    none = F.array().cast("array<bigint>")
    return m.select(
        F.when(F.col("event_id") % 101 == 9, F.col("event_id") - 1).when(F.col("event_id") % 101 != 7, F.col("event_id")).alias("move_id"),
        F.col("ts").alias("move_ts"),
        kind.alias("kind"),
        F.when(kind == "add", (F.col("c_nationkey") + 1) % 26).otherwise(F.col("c_nationkey")).cast("bigint").alias("team_id"),
        F.when(kind == "trade", F.col("partner_nation")).cast("bigint").alias("other_team_id"),
        F.when(kind == "add", none).otherwise(F.array(F.col("user_id"))).alias("send"),
        F.when(kind == "add", F.array(F.col("user_id")))
        .when(kind == "trade", F.array(F.col("partner")))
        .otherwise(none)
        .alias("receive"),
    )


def _apply(spark, d):
    players = S.players(spark, d).select("player_id", "fantasy_team_id")
    teams = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("team_id"))
    return R.apply_roster_moves(players, moves(spark, d), teams)


_MOVES_SQL = (
    S.with_ctes(S.PLAYERS_SQL).replace("WITH", "WITH RECURSIVE", 1)
    + """,
mv AS (
  SELECT CASE WHEN e.event_id % 101 = 9 THEN e.event_id - 1 WHEN e.event_id % 101 <> 7 THEN e.event_id END AS move_id, e.ts AS move_ts,
         CASE e.event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'drop' ELSE 'trade' END AS kind,
         CAST(CASE WHEN e.event_type = 'signup' THEN (c.c_nationkey + 1) % 26 ELSE c.c_nationkey END AS BIGINT) AS team_id,
         CAST(CASE WHEN e.event_type = 'purchase' THEN pc.c_nationkey END AS BIGINT) AS other_team_id,
         e.user_id AS p, e.user_id + 1 AS partner
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
  LEFT JOIN customer pc ON pc.c_custkey = e.user_id + 1
  WHERE e.event_type IN ('signup', 'click', 'purchase')
),
named AS (SELECT * FROM mv WHERE move_id IN (SELECT move_id FROM mv WHERE move_id IS NOT NULL GROUP BY move_id HAVING count(*) = 1)),
rows_ AS (
  SELECT move_id, TRUE AS ok, p AS player_id, CAST(NULL AS BIGINT) AS from_team, team_id AS to_team FROM named WHERE kind = 'add'
  UNION ALL SELECT move_id, TRUE, p, team_id, CAST(NULL AS BIGINT) FROM named WHERE kind = 'drop'
  UNION ALL SELECT move_id, coalesce(team_id <> other_team_id, FALSE), p, team_id, other_team_id FROM named WHERE kind = 'trade'
  UNION ALL SELECT move_id, coalesce(team_id <> other_team_id, FALSE), partner, other_team_id, team_id FROM named WHERE kind = 'trade'
),
checked AS (
  SELECT r.*, pl.fantasy_team_id AS team_before, pl.fantasy_team_id IS DISTINCT FROM r.from_team AS elsewhere,
         CASE WHEN NOT r.ok OR r.player_id IS NULL THEN 0 WHEN pl.player_id IS NULL THEN 1
              WHEN coalesce(r.from_team, 0) > 24 OR coalesce(r.to_team, 0) > 24 THEN 4 END AS static
  FROM rows_ r LEFT JOIN players pl ON pl.player_id = r.player_id
),
own AS (SELECT move_id, min(static) AS static, bool_or(elsewhere) AS elsewhere FROM checked GROUP BY move_id),
seats AS (SELECT player_id, fantasy_team_id, row_number() OVER (ORDER BY player_id) AS seat FROM players),
steps AS (
  SELECT row_number() OVER (ORDER BY n.move_ts NULLS LAST, n.move_id) AS step, n.move_id,
         list(s.seat ORDER BY s.seat) AS pl, list(coalesce(c.from_team, -1) ORDER BY s.seat) AS fr, list(coalesce(c.to_team, -1) ORDER BY s.seat) AS tos
  FROM named n JOIN own o ON o.move_id = n.move_id AND o.static IS NULL JOIN checked c ON c.move_id = n.move_id JOIN seats s ON s.player_id = c.player_id
  GROUP BY n.move_ts, n.move_id
),
run AS (
  SELECT CAST(0 AS BIGINT) AS step, (SELECT list(coalesce(fantasy_team_id, -1) ORDER BY seat) FROM seats) AS st, FALSE AS accepted
  UNION ALL
  SELECT x.step, CASE WHEN x.ok THEN [CASE WHEN list_contains(x.pl, j) THEN x.tos[list_position(x.pl, j)] ELSE x.st[j] END FOR j IN range(1, len(x.st) + 1)] ELSE x.st END, x.ok
  FROM (
    SELECT s.step, r.st, s.pl, s.tos, [r.st[k] FOR k IN s.pl] = s.fr AS ok
    FROM run r JOIN steps s ON s.step = r.step + 1
  ) x
),
decisions AS (
  SELECT n.move_id, n.kind, coalesce(r.accepted, FALSE) AS accepted,
         CASE WHEN NOT coalesce(r.accepted, FALSE) THEN
           CASE WHEN o.static = 0 THEN 'invalid_move' WHEN o.static = 1 THEN 'unknown_player'
                WHEN o.elsewhere THEN 'wrong_team' WHEN o.static = 4 THEN 'unknown_team' ELSE 'conflict' END END AS reason
  FROM named n JOIN own o ON o.move_id = n.move_id LEFT JOIN steps s ON s.move_id = n.move_id LEFT JOIN run r ON r.step = s.step
  UNION ALL
  SELECT move_id, kind, FALSE, 'invalid_move' FROM mv WHERE move_id IS NULL OR move_id NOT IN (SELECT move_id FROM named)
)
"""
)


@register("roster_moves", _MOVES_SQL + "SELECT move_id, kind, accepted, reason FROM decisions")
def roster_moves(spark, d):
    _, decisions = _apply(spark, d)
    return decisions


@register(
    "roster_after_moves",
    _MOVES_SQL
    + """
SELECT s.player_id, nullif(CAST(last.st[s.seat] AS BIGINT), -1) AS fantasy_team_id
FROM seats s, (SELECT st FROM run ORDER BY step DESC LIMIT 1) last""",
)
def roster_after_moves(spark, d):
    after, _ = _apply(spark, d)
    return after


# ----------------------------------------------------------- R1 and R5
@register(
    "roster_create_teams",
    """
WITH req AS (
  SELECT CAST(r_regionkey AS BIGINT) AS move_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(r_regionkey) AS move_ts,
         CASE WHEN r_regionkey = 2 THEN '  ' ELSE 'Club ' || r_name END AS team_name, lower(r_name) AS owner_name
  FROM region
),
ok AS (SELECT * FROM req WHERE length(trim(team_name)) > 0 AND length(trim(owner_name)) > 0),
top AS (SELECT max(n_nationkey) AS m FROM nation)
SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name, CAST(NULL AS VARCHAR) AS owner_name FROM nation
UNION ALL
SELECT CAST((SELECT m FROM top) + row_number() OVER (ORDER BY move_ts, move_id) AS BIGINT), trim(team_name), trim(owner_name)
FROM ok""",
)
def roster_create_teams(spark, d):
    """New roster teams from a request list (one blank name is
    rejected); ids continue after the highest existing id."""
    teams = S.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("team_id"),
        F.col("n_name").alias("team_name"),
        F.lit(None).cast("string").alias("owner_name"),
    )
    req = S.table(spark, d, "region").select(
        F.col("r_regionkey").cast("bigint").alias("move_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=F.col("r_regionkey"))).alias("move_ts"),
        F.when(F.col("r_regionkey") == 2, F.lit("  ")).otherwise(F.concat(F.lit("Club "), "r_name")).alias("team_name"),
        F.lower("r_name").alias("owner_name"),
    )
    out, _ = R.create_teams(teams, req)
    return out


@register(
    "roster_reset",
    S.with_ctes(S.PLAYERS_SQL, S.FANTASY_TEAMS_SQL)
    + """
SELECT 'n_players' AS metric, count(*) AS value FROM players
UNION ALL SELECT 'n_rostered_before', count_if(fantasy_team_id IS NOT NULL) FROM players
UNION ALL SELECT 'n_rostered', 0::BIGINT
UNION ALL SELECT 'n_teams_before', count(*) FROM fantasy_teams
UNION ALL SELECT 'n_teams', 0::BIGINT""",
)
def roster_reset(spark, d):
    """Every player a free agent, no roster team left (one metric per row)."""
    players = S.players(spark, d).select("player_id", "fantasy_team_id")
    teams = S.fantasy_teams(spark, d)
    after, teams_after = R.reset_rosters(players, teams)

    def metric(name, df, expr):
        return df.agg(expr.alias("value")).select(F.lit(name).alias("metric"), "value")

    parts = [
        metric("n_players", after, F.count(F.lit(1))),
        metric("n_rostered_before", players, F.count_if(F.col("fantasy_team_id").isNotNull())),
        metric("n_rostered", after, F.count_if(F.col("fantasy_team_id").isNotNull())),
        metric("n_teams_before", teams, F.count(F.lit(1))),
        metric("n_teams", teams_after, F.count(F.lit(1))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
