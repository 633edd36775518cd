"""Registered ingest and store queries (S8-S10, T1-T12) over the test tables.

Flat stand-ins for the landed files, derived from the tables:

    log lines       one per (order, supplier) of lineitem: the supplier is
                    the player, its nation the team; power-play / short-
                    handed points and the ice time come from the lines
    box-score lines one per (order, supplier) among returned ('R') lines:
                    suppliers with a low balance are goalies
    game headers    orders with a box score (status other than 'P')
    team names      nations of regions 0-3 ("<region> <nation>"); nations
                    of region 4 are unknown codes
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.operators.joins import partitions_for
from rinkspark.plans import standins as S
from rinkspark.plans.registry import register
from rinkspark.sources import ingest as I
from rinkspark.sources import landed as L
from rinkspark.sources import store as ST


from rinkspark.plans.rounding import r4, rnd4  # noqa: E402,F401


_POSITION = (
    "CASE WHEN {b} < 1000 THEN 'G' WHEN {b} < 4000 THEN 'C' WHEN {b} < 7000 THEN 'L' ELSE 'D' END"
)


def line_partitions(spark, d):
    """Into how many partitions the lines are dealt by game."""
    return partitions_for(S.table(spark, d, "lineitem"))


def _lines(spark, d, *order_cols):
    n = line_partitions(spark, d)  # the aggregations on the order follow in the same tasks
    li = S.table(spark, d, "lineitem").repartition(n, "l_orderkey")
    o = S.table(spark, d, "orders").select("o_orderkey", "o_orderdate", *order_cols).repartition(n, "o_orderkey")
    s = S.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)


def log_lines(spark, d):
    lines = _lines(spark, d)
    per = lines.groupBy("l_orderkey", "l_suppkey", "s_nationkey", "o_orderdate").agg(
        F.sum(F.round(F.col("l_discount") * 100)).cast("int").alias("pp_points"),
        F.sum(F.round(F.col("l_tax") * 100)).cast("int").alias("sh_points"),
        F.format_string("%d:%02d", F.sum("l_quantity").cast("int"), (F.count(F.lit(1)) * 7).cast("int")).alias("toi"),
        F.count(F.lit(1)).cast("int").alias("shifts"),
    )
    nat = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team_abbrev"))
    return S.join_small(per, nat, "s_nationkey", "inner", S.NATION_ROWS_MAX).select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_suppkey").alias("player_id"),
        "team_abbrev",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("log_game_date"),
        "pp_points",
        "sh_points",
        "toi",
        "shifts",
    )


LOG_SQL = """
log_lines AS (
  SELECT l.l_orderkey AS game_id, l.l_suppkey AS player_id, n.n_name AS team_abbrev,
         strftime(o.o_orderdate, '%Y-%m-%d') AS log_game_date,
         CAST(sum(round(l.l_discount * 100)) AS INTEGER) AS pp_points,
         CAST(sum(round(l.l_tax * 100)) AS INTEGER) AS sh_points,
         printf('%d:%02d', CAST(sum(l.l_quantity) AS INTEGER), CAST(count(*) * 7 AS INTEGER)) AS toi,
         CAST(count(*) AS INTEGER) AS shifts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY l.l_orderkey, l.l_suppkey, n.n_name, o.o_orderdate
)"""


def box_lines(spark, d):
    r = _lines(spark, d).where(F.col("l_returnflag") == "R")
    pos = F.expr(_POSITION.format(b="s_acctbal"))
    per = r.groupBy("l_orderkey", "l_suppkey", "s_name", "s_nationkey", "s_acctbal").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.min("l_linenumber").alias("lo"),
        F.max("l_linenumber").alias("hi"),
        F.sum("l_quantity").cast("int").alias("q"),
        F.max("l_linestatus").alias("st"),
        F.avg(F.lit(1.0) - F.col("l_discount")).alias("sp"),
    )
    g = pos == "G"
    return per.select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_suppkey").alias("player_id"),
        F.col("s_name").alias("box_name"),
        pos.alias("box_position"),
        F.when(~g, F.col("n")).alias("goals"),
        F.when(~g, F.col("lo")).alias("assists"),
        F.when(~g, F.col("q")).alias("shots"),
        F.when(~g, F.col("hi")).alias("blocked_shots"),
        F.when(~g, F.col("n")).alias("hits"),
        F.col("s_nationkey").alias("jersey_number"),
        F.when(g, F.col("q")).alias("saves"),
        F.when(g, F.col("sp")).alias("save_pct"),
        F.when(g, F.col("lo") - 1).alias("goals_against"),
        F.when(g, F.when(F.col("st") == "F", F.lit("W")).otherwise(F.lit("O"))).alias("decision"),
    )


BOX_SQL = (
    """
box_agg AS (
  SELECT l.l_orderkey AS game_id, l.l_suppkey AS player_id, s.s_name AS box_name,
         """
    + _POSITION.format(b="s.s_acctbal")
    + """ AS box_position, s.s_nationkey AS jersey_number,
         CAST(count(*) AS INTEGER) AS n, min(l.l_linenumber) AS lo, max(l.l_linenumber) AS hi,
         CAST(sum(l.l_quantity) AS INTEGER) AS q, max(l.l_linestatus) AS st, avg(1.0 - l.l_discount) AS sp
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE l.l_returnflag = 'R'
  GROUP BY l.l_orderkey, l.l_suppkey, s.s_name, s.s_nationkey, s.s_acctbal
),
box_lines AS (
  SELECT game_id, player_id, box_name, box_position, jersey_number,
         CASE WHEN box_position <> 'G' THEN n END AS goals, CASE WHEN box_position <> 'G' THEN lo END AS assists,
         CASE WHEN box_position <> 'G' THEN q END AS shots, CASE WHEN box_position <> 'G' THEN hi END AS blocked_shots,
         CASE WHEN box_position <> 'G' THEN n END AS hits,
         CASE WHEN box_position = 'G' THEN q END AS saves, CASE WHEN box_position = 'G' THEN sp END AS save_pct,
         CASE WHEN box_position = 'G' THEN lo - 1 END AS goals_against,
         CASE WHEN box_position = 'G' THEN CASE WHEN st = 'F' THEN 'W' ELSE 'O' END END AS decision
  FROM box_agg
)"""
)


def headers(spark, d):
    """Game headers of games with a box score, carrying the schedule's season."""
    g = S.games(spark, d)
    return g.where(F.col("o_orderstatus") != "P").select(
        "game_id", "home_abbrev", "away_abbrev", F.col("season").cast("string").alias("season")
    )


def team_names(spark, d):
    n = S.table(spark, d, "nation")
    r = S.table(spark, d, "region")
    return (
        n.where(F.col("n_regionkey") < 4)
        .transform(lambda x: S.join_small(x, r, x.n_regionkey == r.r_regionkey))
        .select(F.col("n_name").alias("abbrev"), F.concat_ws(" ", "r_name", "n_name").alias("name"))
    )


ENRICH_SQL = (
    S.with_ctes(S.GAMES_SQL, LOG_SQL, BOX_SQL)
    + """,
names AS (SELECT n.n_name AS abbrev, r.r_name || ' ' || n.n_name AS name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_regionkey < 4),
hdr AS (SELECT game_id, home_abbrev, away_abbrev, CAST(season AS VARCHAR) AS season FROM games WHERE o_orderstatus <> 'P'),
j AS (
  SELECT lg.game_id, lg.player_id, CAST(lg.log_game_date AS DATE) AS game_date, h.season, lg.team_abbrev,
         CASE WHEN lg.team_abbrev = h.home_abbrev THEN h.away_abbrev ELSE h.home_abbrev END AS opponent_abbrev,
         coalesce(b.box_name, 'N/A') AS player_name, b.jersey_number, coalesce(b.box_position, 'N/A') AS raw_position,
         coalesce(b.goals, 0) AS goals, coalesce(b.assists, 0) AS assists,
         CAST(coalesce(lg.pp_points, 0) AS DOUBLE) AS pp_points, CAST(coalesce(lg.sh_points, 0) AS DOUBLE) AS sh_points,
         coalesce(b.shots, 0) AS shots, coalesce(b.blocked_shots, 0) AS blocked_shots, coalesce(b.hits, 0) AS hits,
         coalesce(lg.toi, '00:00') AS toi, coalesce(lg.shifts, 0) AS shifts,
         b.saves, b.save_pct, b.goals_against, b.decision
  FROM log_lines lg LEFT JOIN box_lines b ON lg.game_id = b.game_id AND lg.player_id = b.player_id
  JOIN hdr h ON h.game_id = lg.game_id
),
e AS (
  SELECT j.*, coalesce(t.name, 'Unknown') AS team_name, coalesce(o.name, 'Unknown') AS opponent_name
  FROM j LEFT JOIN names t ON t.abbrev = j.team_abbrev LEFT JOIN names o ON o.abbrev = j.opponent_abbrev
)
"""
)


@register(
    "enrich_lines",
    ENRICH_SQL
    + """
SELECT game_id, player_id, game_date, season, team_abbrev, team_name, opponent_abbrev, opponent_name, player_name,
       jersey_number, raw_position AS position, goals, assists, pp_points, sh_points, shots,
       round(CASE WHEN shots = 0 THEN NULL ELSE CAST(goals AS DOUBLE) / shots END, 4) AS shooting_pct,
       blocked_shots, hits,
       CASE WHEN len(string_split(toi, ':')) = 2 THEN CAST(string_split(toi, ':')[1] AS INTEGER) * 60 + CAST(string_split(toi, ':')[2] AS INTEGER) ELSE 0 END AS toi_seconds,
       shifts,
       round(CAST(goals AS DOUBLE) * 2.0 + CAST(assists AS DOUBLE) * 1.0 + pp_points * 0.5 + sh_points * 0.5
             + CAST(shots AS DOUBLE) * 0.1 + CAST(blocked_shots AS DOUBLE) * 0.5 + CAST(hits AS DOUBLE) * 0.1, 2) AS total_fpts
FROM e WHERE raw_position <> 'G'""",
)
def enrich_lines(spark, d):
    enriched = I.enrich(log_lines(spark, d), box_lines(spark, d), headers(spark, d), team_names(spark, d))
    out = I.skater_fact(enriched)
    return out.select(*[r4(c) if c == "shooting_pct" else c for c in out.columns])


@register(
    "enrich_goalie_lines",
    ENRICH_SQL
    + """
SELECT game_id, player_id, game_date, season, team_abbrev, team_name, opponent_abbrev, opponent_name, player_name,
       jersey_number, 'Goalie' AS position, coalesce(saves, 0) AS saves, round(coalesce(save_pct, 0.0), 4) AS save_pct,
       coalesce(goals_against, 0) AS goals_against, decision,
       CASE WHEN decision = 'W' THEN 1 ELSE 0 END AS wins,
       CASE WHEN goals_against = 0 AND coalesce(saves, 0) > 0 THEN 1 ELSE 0 END AS shutouts,
       CASE WHEN decision = 'O' THEN 1 ELSE 0 END AS ot_losses,
       round(CAST(CASE WHEN decision = 'W' THEN 1 ELSE 0 END AS DOUBLE) * 4.0 + CAST(coalesce(goals_against, 0) AS DOUBLE) * -2.0
             + CAST(coalesce(saves, 0) AS DOUBLE) * 0.2
             + CAST(CASE WHEN goals_against = 0 AND coalesce(saves, 0) > 0 THEN 1 ELSE 0 END AS DOUBLE) * 3.0
             + CAST(CASE WHEN decision = 'O' THEN 1 ELSE 0 END AS DOUBLE) * 1.0, 2) + 0.0 AS total_fpts
FROM e WHERE raw_position = 'G'""",
)
def enrich_goalie_lines(spark, d):
    enriched = I.enrich(log_lines(spark, d), box_lines(spark, d), headers(spark, d), team_names(spark, d))
    out = I.goalie_fact(enriched)
    return out.select(*[r4(c) if c in ("save_pct", "total_fpts") else c for c in out.columns])


# ----------------------------------------------------------- S10 + T6
BATCH_FROM = "1998-01-01"


@register(
    "games_to_process",
    S.with_ctes(S.GAMES_SQL)
    + f""",
requested AS (SELECT game_id FROM games WHERE game_date >= DATE '{BATCH_FROM}'),
reg AS (SELECT game_id, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'pending' END AS status FROM games),
todo AS (SELECT * FROM requested WHERE game_id NOT IN (SELECT game_id FROM reg WHERE status = 'final')),
players AS (SELECT s_suppkey AS player_id FROM supplier WHERE s_acctbal > 0)
SELECT l_orderkey AS game_id, l_linenumber, l_suppkey AS player_id, l_quantity
FROM lineitem
WHERE l_orderkey IN (SELECT game_id FROM todo) AND l_suppkey IN (SELECT player_id FROM players)""",
)
def games_to_process(spark, d):
    g = S.games(spark, d)
    requested = g.where(F.col("game_date") >= F.lit(BATCH_FROM).cast("date")).select("game_id")
    reg = g.select("game_id", F.when(F.col("o_orderstatus") == "F", "final").otherwise("pending").alias("status"))
    todo = L.games_to_process(requested, reg)
    players = S.table(spark, d, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("player_id"))
    li = S.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), "l_linenumber", F.col("l_suppkey").alias("player_id"), "l_quantity"
    )
    return L.restrict_to_batch(li, todo, players)


# --------------------------------------------------------------- T1-T3, T5
@register(
    "schedule_flatten",
    S.with_ctes(S.GAMES_SQL)
    + """,
a AS (SELECT * FROM games WHERE season <= 1998),
b AS (SELECT * FROM games WHERE season >= 1997),
u AS (SELECT DISTINCT game_id, season, game_type, start_time_utc, home_abbrev, away_abbrev FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT game_id, season, CAST(start_time_utc AS TIMESTAMP) AS start_time_utc, home_abbrev, away_abbrev,
       count(*) OVER (PARTITION BY home_abbrev) AS home_games
FROM u WHERE game_type = 2""",
)
def schedule_flatten(spark, d):
    g = S.games(spark, d).select("game_id", "season", "game_type", "start_time_utc", "home_abbrev", "away_abbrev")
    both = g.where(F.col("season") <= 1998).unionByName(g.where(F.col("season") >= 1997))
    one = L.regular_season(L.unique_games(both, version_col=None))
    per_home = one.groupBy("home_abbrev").agg(F.count(F.lit(1)).alias("home_games"))
    return one.join(per_home, "home_abbrev", "inner").select(
        "game_id", "season", "start_time_utc",
        "home_abbrev", "away_abbrev", "home_games",
    )


@register(
    "batch_players",
    """
SELECT DISTINCT l_suppkey AS player_id FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus = 'F'""",
)
def batch_players_q(spark, d):
    li = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("player_id"))
    games = S.table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("game_id"))
    return L.batch_players(li.join(games, "game_id", "left_semi"))


# --------------------------------------------------------------------- S8
@register(
    "fact_upsert",
    """
WITH old AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
new AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 1 AS l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01'
),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC,
               l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS rn FROM new) WHERE rn = 1
)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM old
WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.l_orderkey = old.l_orderkey AND best.l_linenumber = old.l_linenumber)
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM best""",
)
def fact_upsert(spark, d):
    li = S.table(spark, d, "lineitem")
    old = li.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    new = li.where(F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).withColumn(
        "l_quantity", F.col("l_quantity") + 1
    )
    out = ST.upsert(old, new, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


# --------------------------------------------------------------------- S9
@register(
    "partial_upsert",
    """
WITH old AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'),
new AS (SELECT c_custkey, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT coalesce(old.c_custkey, new.c_custkey) AS c_custkey, old.c_name, old.c_nationkey,
       round(CASE WHEN new.c_custkey IS NOT NULL THEN new.c_acctbal ELSE old.c_acctbal END, 4) AS c_acctbal,
       old.c_mktsegment
FROM old FULL OUTER JOIN new ON old.c_custkey = new.c_custkey""",
)
def partial_upsert(spark, d):
    c = S.table(spark, d, "customer")
    old = c.where(F.col("c_mktsegment") != "BUILDING")
    new = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        "c_custkey", (F.col("c_acctbal") + 100).alias("c_acctbal")
    )
    out = ST.partial_upsert(old, new, "c_custkey", ["c_acctbal"])
    return out.select("c_custkey", "c_name", "c_nationkey", r4("c_acctbal"), "c_mktsegment")


# ------------------------------------------------------ B12 quality count
@register(
    "enrich_quality",
    ENRICH_SQL
    + """
SELECT count(*) AS n_lines,
       count_if(j2.team_abbrev <> h.home_abbrev AND j2.team_abbrev <> h.away_abbrev) AS unmatched_team_lines
FROM j j2 JOIN hdr h ON h.game_id = j2.game_id""",
)
def enrich_quality(spark, d):
    """Lines whose team is neither side of their game (the opponent rule
    falls back to the home side for them)."""
    enriched = I.enrich(log_lines(spark, d), box_lines(spark, d), headers(spark, d), team_names(spark, d))
    return I.unmatched_team_count(enriched)


# -------------------------------------------------------- S11 contract
@register(
    "contract_check",
    """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count_if(l_shipdate IS NULL) AS ns, count_if(l_partkey IS NULL) AS np
           FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0)::BIGINT AS duplicate_keys,
       coalesce(sum(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN n END), 0)::BIGINT AS null_keys,
       coalesce(sum(ns), 0)::BIGINT AS null_l_shipdate, coalesce(sum(np), 0)::BIGINT AS null_l_partkey
FROM k""",
)
def contract_check(spark, d):
    """S11 as a quality job on the line table's (order, line number) key."""
    li = S.table(spark, d, "lineitem")
    return ST.contract_violations(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])
