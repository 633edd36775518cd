"""Domain-shaped views over the supplied test tables.

The registered queries run the library operators over these views. Each
view has a Spark builder and the equivalent SQL (used by the DuckDB oracle),
kept side by side so the two stay in step.

Mapping (all derived from the supplied tables, so work grows with them):

    players        customer: player_id = c_custkey, name = c_name, pro team
                   = customer's nation, goalies are the AUTOMOBILE segment,
                   rostered (fantasy team = nation) when c_acctbal >= 0
    fantasy teams  nation (id = n_nationkey) plus region (id = 100 + key),
                   regions own no players, so empty rosters exist
    games          orders: home = customer's nation, away = a second nation
                   derived from the order key, start = o_orderdate plus
                   (o_orderkey mod 24) hours as a UTC instant, game type 2
                   for status F, 3 for O, 1 for P
    skater lines   lineitem joined to orders (player, date, season) and to
                   supplier's nation (opponent); measures from line columns
    goalie lines   one per order: decision from status, goals against and
                   saves from the price, opponent = away nation
    event lines    events: player = user_id, date = ts, opponent =
                   event_type, points = value
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.functions.calendar import league_date
from rinkspark.functions.scoring import goalie_points, ratio_or_null, shutout_flag, skater_points
from rinkspark.functions.scoring import ot_loss_flag, win_flag
from rinkspark.operators.joins import join_small

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Nations are the teams; TPC-H fixes their number (25), still size-checked.
NATION_ROWS_MAX = 10_000


# Declared schemas of the supplied tables the queries read (no inference).
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = SOURCE_SCHEMAS.get(name)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def _nations(spark, d, key="n_nationkey", name="n_name"):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))


# ---------------------------------------------------------------- players
def players(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    goalie = F.col("c_mktsegment") == "AUTOMOBILE"
    base = c.select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("player_name"),
        F.col("c_nationkey"),
        F.when(goalie, F.lit("G")).otherwise(F.substring("c_mktsegment", 1, 1)).alias("position"),
        goalie.alias("is_goalie"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("bigint")).alias("fantasy_team_id"),
        F.col("c_acctbal").alias("acctbal"),
    )
    out = join_small(base, _nations(spark, d, "c_nationkey", "team_abbrev"), "c_nationkey", "inner", NATION_ROWS_MAX)
    return out.drop("c_nationkey")


PLAYERS_SQL = """
players AS (
  SELECT c.c_custkey AS player_id, c.c_name AS player_name, n.n_name AS team_abbrev,
         CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'G' ELSE substring(c.c_mktsegment, 1, 1) END AS position,
         c.c_mktsegment = 'AUTOMOBILE' AS is_goalie,
         CASE WHEN c.c_acctbal >= 0 THEN CAST(c.c_nationkey AS BIGINT) END AS fantasy_team_id,
         c.c_acctbal AS acctbal
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def fantasy_teams(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    nations = join_small(n, r, n.n_regionkey == r.r_regionkey, "inner").select(
        F.col("n_nationkey").cast("bigint").alias("team_id"),
        F.col("n_name").alias("team_name"),
        F.col("r_name").alias("owner_name"),
    )
    regions = r.select(
        (F.col("r_regionkey") + 100).cast("bigint").alias("team_id"),
        F.concat(F.lit("Team "), F.col("r_name")).alias("team_name"),
        F.col("r_name").alias("owner_name"),
    )
    return nations.unionByName(regions)


FANTASY_TEAMS_SQL = """
fantasy_teams AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS team_id, n.n_name AS team_name, r.r_name AS owner_name
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT CAST(r_regionkey + 100 AS BIGINT) AS team_id, 'Team ' || r_name AS team_name, r_name AS owner_name
  FROM region
)"""


# ------------------------------------------------------------------ games
def games(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    # UTC wall time, kept as timestamp_ntz (no session-zone dependence).
    start = F.col("o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    g = o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_custkey").alias("player_id"),
        F.year("o_orderdate").alias("season"),
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 3).otherwise(1).alias(
            "game_type"
        ),
        start.alias("start_time_utc"),
        F.col("c_nationkey").alias("home_key"),
        ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int").alias("away_key"),
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
    )
    g = join_small(g, _nations(spark, d, "home_key", "home_abbrev"), "home_key", "inner", NATION_ROWS_MAX)
    g = join_small(g, _nations(spark, d, "away_key", "away_abbrev"), "away_key", "inner", NATION_ROWS_MAX)
    return g.drop("home_key", "away_key").withColumn("game_date", league_date("start_time_utc"))


GAMES_SQL = """
games AS (
  SELECT o.o_orderkey AS game_id, o.o_custkey AS player_id, CAST(year(o.o_orderdate) AS INTEGER) AS season,
         CASE o.o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 1 END AS game_type,
         o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS INTEGER)) AS start_time_utc,
         h.n_name AS home_abbrev, a.n_name AS away_abbrev,
         o.o_orderstatus, o.o_totalprice, o.o_orderpriority,
         CAST(timezone('America/New_York', (o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS INTEGER))) AT TIME ZONE 'UTC') AS DATE) AS game_date
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation h ON h.n_nationkey = c.c_nationkey
  JOIN nation a ON a.n_nationkey = CAST((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 AS INTEGER)
)"""


# ------------------------------------------------------------- club games
# Nations are 25 at any scale, so a nation's week grows with the data. Clubs
# of ten customers grow in number instead, as leagues do: a club's week stays
# a handful of games.
CLUB_SIZE = 10


def club(player: Column, shift: int = 0) -> Column:
    """Code of a customer's club (or of the ``shift``-th club after it)."""
    return F.concat(F.lit("T"), (F.floor(player / CLUB_SIZE) + shift).cast("string"))


def club_games(spark: SparkSession, d: str) -> DataFrame:
    """Games between neighbouring clubs: the orderer's club at home."""
    start = F.col("o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    g = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 3).otherwise(1).alias("game_type"),
        start.alias("start_time_utc"),
        club(F.col("o_custkey")).alias("home_abbrev"),
        club(F.col("o_custkey"), 1).alias("away_abbrev"),
    )
    return g.withColumn("game_date", league_date("start_time_utc"))


CLUB_GAMES_SQL = """
club_games AS (
  SELECT o_orderkey AS game_id, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 1 END AS game_type,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS start_time_utc,
         'T' || CAST(o_custkey // 10 AS VARCHAR) AS home_abbrev, 'T' || CAST(o_custkey // 10 + 1 AS VARCHAR) AS away_abbrev,
         CAST(timezone('America/New_York', (o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))) AT TIME ZONE 'UTC') AS DATE) AS game_date
  FROM orders
)"""


# ----------------------------------------------------------- skater lines
def skater_lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    lines = li.join(o, li.l_orderkey == o.o_orderkey, "inner").join(s, li.l_suppkey == s.s_suppkey, "inner")
    lines = join_small(lines, _nations(spark, d, "s_nationkey", "opponent_abbrev"), "s_nationkey", "inner", NATION_ROWS_MAX)
    out = lines.select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_custkey").alias("player_id"),
        F.to_date("o_orderdate").alias("game_date"),
        F.year("o_orderdate").cast("string").alias("season"),
        "opponent_abbrev",
        F.when(F.col("l_linestatus") == "F", F.lit("C")).otherwise(F.lit("D")).alias("position"),
        F.col("l_linenumber").alias("jersey_number"),
        F.col("l_linenumber").alias("goals"),
        F.col("l_quantity").cast("int").alias("assists"),
        F.round(F.col("l_discount") * 100).alias("pp_points"),
        F.round(F.col("l_tax") * 100).alias("sh_points"),
        F.dayofmonth("l_shipdate").alias("shots"),
        F.when(F.col("l_returnflag") != "N", F.month("l_shipdate")).alias("blocked_shots"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("hits"),
        (F.col("l_quantity") * 30).cast("int").alias("toi_seconds"),
    )
    return out.withColumn("total_fpts", skater_points()).withColumn(
        "shooting_pct", ratio_or_null("goals", "shots")
    )


SKATER_LINES_SQL = """
skater_base AS (
  SELECT l.l_orderkey AS game_id, l.l_linenumber AS line_no, o.o_custkey AS player_id,
         CAST(o.o_orderdate AS DATE) AS game_date, CAST(year(o.o_orderdate) AS VARCHAR) AS season,
         n.n_name AS opponent_abbrev,
         CASE WHEN l.l_linestatus = 'F' THEN 'C' ELSE 'D' END AS position, l.l_linenumber AS jersey_number,
         l.l_linenumber AS goals, CAST(trunc(l.l_quantity) AS INTEGER) AS assists,
         round(l.l_discount * 100) AS pp_points, round(l.l_tax * 100) AS sh_points,
         CAST(day(l.l_shipdate) AS INTEGER) AS shots,
         CASE WHEN l.l_returnflag <> 'N' THEN CAST(month(l.l_shipdate) AS INTEGER) END AS blocked_shots,
         CAST(floor(l.l_quantity / 10) AS INTEGER) AS hits,
         CAST(trunc(l.l_quantity * 30) AS INTEGER) AS toi_seconds
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
),
skater_lines AS (
  SELECT *,
         round(CAST(goals AS DOUBLE) * 2.0 + CAST(assists AS DOUBLE) * 1.0 + coalesce(pp_points, 0) * 0.5
               + coalesce(sh_points, 0) * 0.5 + CAST(shots AS DOUBLE) * 0.1
               + CAST(coalesce(blocked_shots, 0) AS DOUBLE) * 0.5 + CAST(hits AS DOUBLE) * 0.1, 2) AS total_fpts,
         CASE WHEN shots = 0 THEN NULL ELSE CAST(goals AS DOUBLE) / shots END AS shooting_pct
  FROM skater_base
)"""


# ----------------------------------------------------------- goalie lines
def goalie_lines(spark: SparkSession, d: str) -> DataFrame:
    g = games(spark, d)
    decision = (
        F.when(F.col("o_orderstatus") == "F", F.lit("W"))
        .when(F.col("o_orderstatus") == "O", F.lit("O"))
        .otherwise(F.lit("L"))
    )
    ga = F.when(F.col("o_orderpriority") != "5-LOW", F.floor(F.col("o_totalprice") / 100000).cast("int"))
    sv = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.floor(F.col("o_totalprice") / 20000).cast("int"))
    out = g.select(
        "game_id",
        "player_id",
        "game_date",
        F.col("season").cast("string").alias("season"),
        F.col("home_abbrev").alias("team_abbrev"),
        F.col("away_abbrev").alias("opponent_abbrev"),
        decision.alias("decision"),
        ga.alias("goals_against"),
        sv.alias("saves"),
    )
    return out.select(
        "*",
        F.coalesce(ratio_or_null("saves", F.col("saves") + F.col("goals_against")), F.lit(0.0)).alias("save_pct"),
        win_flag().alias("wins"),
        shutout_flag().alias("shutouts"),
        ot_loss_flag().alias("ot_losses"),
        goalie_points().alias("total_fpts"),
    )


GOALIE_LINES_SQL = (
    GAMES_SQL
    + """,
goalie_base AS (
  SELECT game_id, player_id, game_date, CAST(season AS VARCHAR) AS season,
         home_abbrev AS team_abbrev, away_abbrev AS opponent_abbrev,
         CASE o_orderstatus WHEN 'F' THEN 'W' WHEN 'O' THEN 'O' ELSE 'L' END AS decision,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice / 100000) AS INTEGER) END AS goals_against,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(floor(o_totalprice / 20000) AS INTEGER) END AS saves
  FROM games
),
goalie_lines AS (
  SELECT *,
         coalesce(CASE WHEN saves + goals_against = 0 THEN NULL ELSE CAST(saves AS DOUBLE) / (saves + goals_against) END, 0.0) AS save_pct,
         CASE WHEN decision = 'W' THEN 1 ELSE 0 END AS wins,
         CASE WHEN goals_against = 0 AND coalesce(saves, 0) > 0 THEN 1 ELSE 0 END AS shutouts,
         CASE WHEN decision = 'O' THEN 1 ELSE 0 END AS ot_losses,
         round(CAST(CASE WHEN decision = 'W' THEN 1 ELSE 0 END AS DOUBLE) * 4.0
               + CAST(coalesce(goals_against, 0) AS DOUBLE) * -2.0
               + CAST(coalesce(saves, 0) AS DOUBLE) * 0.2
               + CAST(CASE WHEN goals_against = 0 AND coalesce(saves, 0) > 0 THEN 1 ELSE 0 END AS DOUBLE) * 3.0
               + CAST(CASE WHEN decision = 'O' THEN 1 ELSE 0 END AS DOUBLE) * 1.0, 2) AS total_fpts
  FROM goalie_base
)"""
)


# ------------------------------------------------------------ event lines
def event_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("game_id"),
        F.col("user_id").alias("player_id"),
        F.to_date("ts").alias("game_date"),
        F.year("ts").cast("string").alias("season"),
        F.col("event_type").alias("opponent_abbrev"),
        F.col("value").alias("total_fpts"),
        "ts",
    )


EVENT_LINES_SQL = """
event_lines AS (
  SELECT event_id AS game_id, user_id AS player_id, CAST(ts AS DATE) AS game_date,
         CAST(year(ts) AS VARCHAR) AS season, event_type AS opponent_abbrev, value AS total_fpts, ts
  FROM events
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
