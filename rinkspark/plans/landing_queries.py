"""Registered queries of the landed-file readers (S1-S3, T1-T5) and of the
daily merge (S8): the tables are written as the JSON documents that a landing
job drops, then read with the declared readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.plans import ingest_queries as Q
from rinkspark.plans import standins as S
from rinkspark.plans.registry import register
from rinkspark.sources import daily_update as U
from rinkspark.sources import ingest as I
from rinkspark.sources import landed as L
from rinkspark.sources import store as ST
from rinkspark.streaming.totals import work_root

EARLY, LATE = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"
DOCS_PER_FILE = 200_000


def _land(spark, name, *landings):
    """Write DataFrames of documents as gzipped JSON lines, one folder per
    landing. Such a file is read by one task, so its documents are bounded."""
    root = work_root(spark, name)
    for i, docs in enumerate(landings):
        docs.write.option("maxRecordsPerFile", DOCS_PER_FILE).json(f"{root}/landing-{i}", compression="gzip")
    return f"{root}/landing-*"


@register(
    "schedule_games",
    S.with_ctes(S.CLUB_GAMES_SQL)
    + """
SELECT game_id, CAST(year(start_time_utc) AS INTEGER) AS season, start_time_utc,
       CASE WHEN game_id % 2 = 0 THEN 'OFF' ELSE 'FUT' END AS game_state, home_abbrev, away_abbrev
FROM club_games WHERE game_type = 2""",
)
def schedule_games(spark, d):
    """Both clubs' files hold a game; half of the games are landed
    again as over, and the later landing wins."""
    g = S.club_games(spark, d)

    def docs(games, state, landed_at):
        def team(code):
            return F.struct(F.col(code).alias("abbrev"), F.struct(F.col(code).alias("default")).alias("commonName"))

        game = F.struct(
            F.col("game_id").alias("id"),
            F.year("start_time_utc").alias("season"),
            F.col("game_type").alias("gameType"),
            F.date_format("start_time_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startTimeUTC"),
            F.lit(state).alias("gameState"),
            team("home_abbrev").alias("homeTeam"),
            team("away_abbrev").alias("awayTeam"),
        )
        return games.select(F.array(game).alias("games"), F.lit(landed_at).alias("landed_at"))

    first = docs(g, "FUT", EARLY)
    path = _land(spark, "schedules", first.unionAll(first), docs(g.where(F.col("game_id") % 2 == 0), "OFF", LATE))
    games = L.regular_season(L.unique_games(L.read_schedules(spark, path)))
    return games.select("game_id", "season", F.col("start_time_utc").cast("timestamp_ntz").alias("start_time_utc"), "game_state", "home_abbrev", "away_abbrev")


def _box_docs(rows):
    """Box-score documents of lines: players of even ids are the away side's;
    arrays are in the order of the player ids."""
    line = F.struct(
        F.col("player_id").alias("playerId"),
        F.struct(F.col("box_name").alias("default")).alias("name"),
        F.col("box_position").alias("position"),
        "goals",
        "assists",
        F.col("shots").alias("sog"),
        F.col("blocked_shots").alias("blockedShots"),
        "hits",
        "saves",
        F.col("save_pct").alias("savePctg"),
        F.col("goals_against").alias("goalsAgainst"),
        "decision",
        F.col("jersey_number").alias("sweaterNumber"),
    )
    p = F.col("box_position")
    groups = {"forwards": ~p.isin("G", "D"), "defense": p == "D", "goalies": p == "G"}

    def side(rest):
        mine = F.col("player_id") % 2 == rest
        return F.struct(*[F.array_sort(F.collect_list(F.when(mine & cond, line))).alias(g) for g, cond in groups.items()])  # seven lines at most

    return rows.groupBy(F.col("game_id").alias("id")).agg(F.struct(side(0).alias("awayTeam"), side(1).alias("homeTeam")).alias("playerByGameStats"))


def _box_landings(spark, rows, root):
    """The documents of two landings, the earlier without goals, from one
    grouping of the lines: by landing time."""
    docs = U._stage(_box_docs(rows), root, "docs")

    def group(side, name):
        lines = F.col(f"playerByGameStats.{side}.{name}")
        return F.array_sort(F.transform(lines, lambda x: x.withField("goals", F.lit(0)))).alias(name)

    def no_goals(side):
        return F.struct(*[group(side, name) for name in ("forwards", "defense", "goalies")]).alias(side)

    early = docs.withColumn("playerByGameStats", F.struct(no_goals("awayTeam"), no_goals("homeTeam")))
    return {at: x.withColumn("landed_at", F.lit(at)) for at, x in ((EARLY, early), (LATE, docs))}


@register(
    "boxscore_lines",
    S.with_ctes(Q.BOX_SQL)
    + """,
sided AS (
  SELECT *, CASE WHEN player_id % 2 = 0 THEN 'away' ELSE 'home' END AS side,
         CASE box_position WHEN 'G' THEN 'goalies' WHEN 'D' THEN 'defense' ELSE 'forwards' END AS "group"
  FROM box_lines
)
SELECT game_id, player_id, side, "group",
       CAST(row_number() OVER (PARTITION BY game_id ORDER BY side, CASE "group" WHEN 'forwards' THEN 0 WHEN 'defense' THEN 1 ELSE 2 END, player_id) - 1 AS INTEGER) AS slot,
       box_name, box_position, goals, assists, shots, hits, saves, goals_against, decision
FROM sided""",
)
def boxscore_lines(spark, d):
    """One box score per order with the player arrays of both sides,
    landed twice (a first landing without goals loses)."""
    path = _land(spark, "boxscores", *_box_landings(spark, Q.box_lines(spark, d), work_root(spark, "boxscores-docs")).values())
    out = L.box_lines(L.read_boxscores(spark, path))
    return out.select("game_id", "player_id", "side", "group", "slot", "box_name", "box_position", "goals", "assists", "shots", "hits", "saves", "goals_against", "decision")


@register(
    "register_replay",
    Q.ENRICH_SQL
    + """
SELECT game_id, player_id, game_date, season, team_abbrev, opponent_abbrev, player_name, raw_position AS position, goals, assists, shots, hits
FROM e WHERE raw_position NOT IN ('G', 'N/A')""",
)
def register_replay(spark, d):
    """S10 with payload: landed box scores and logs go into the register as
    VARIANT, an earlier landing without goals first; the skater facts are then
    rebuilt from the register alone."""
    root = work_root(spark, "register")
    # Logs and register are dealt by game once: a game's rows meet where they lie.
    with ST.bucketed(spark, "game_id", Q.line_partitions(spark, d)) as tables:
        log = tables.append(Q.log_lines(spark, d), f"{root}/log")
        for at, docs in _box_landings(spark, Q.box_lines(spark, d), root).items():
            path = _land(spark, f"register-{at[:10]}", docs)
            kept = tables.append(L.register_payload(L.read_boxscores(spark, path, tables.n), log), f"{root}/register")
        box, again = L.replay_payload(kept, log.schema)
    facts = I.skater_fact(I.enrich(again, L.box_lines(box), Q.headers(spark, d), Q.team_names(spark, d)))
    facts = facts.where(F.col("position") != "N/A")  # the register holds games with a box score
    return facts.select("game_id", "player_id", "game_date", "season", "team_abbrev", "opponent_abbrev", "player_name", "position", "goals", "assists", "shots", "hits")


@register(
    "player_logs",
    S.with_ctes(Q.LOG_SQL) + "SELECT game_id, player_id, team_abbrev, log_game_date, pp_points, sh_points, toi, shifts FROM log_lines",
)
def player_logs(spark, d):
    """S3: logs per player and month, with an earlier landing of every entry
    that counted no shifts."""
    rows = Q.log_lines(spark, d)
    entry = F.struct(
        F.col("game_id").alias("gameId"),
        F.col("team_abbrev").alias("teamAbbrev"),
        F.col("log_game_date").alias("gameDate"),
        F.col("pp_points").alias("powerPlayPoints"),
        F.col("sh_points").alias("shorthandedPoints"),
        "toi",
        "shifts",
    )
    # A player's month of one team, in parts of the game id: small arrays.
    part = [F.col("player_id"), F.substring("log_game_date", 1, 7), F.col("game_id") % 64]
    docs = rows.groupBy(*[c.alias(f"k{i}") for i, c in enumerate(part)]).agg(F.collect_list(entry).alias("gameLog"))
    docs = U._stage(docs.select(F.col("k0").alias("player_id"), "gameLog"), work_root(spark, "logs-docs"), "docs")  # grouped once
    early = docs.withColumn("gameLog", F.transform("gameLog", lambda e: e.withField("shifts", F.lit(0))))

    path = _land(spark, "logs", early.withColumn("landed_at", F.lit(EARLY)), docs.withColumn("landed_at", F.lit(LATE)))
    out = L.read_player_logs(spark, path)
    return out.select("game_id", "player_id", "team_abbrev", "log_game_date", "pp_points", "sh_points", "toi", "shifts")


@register(
    "daily_merge",
    Q.ENRICH_SQL
    + """
SELECT game_id, player_id, season,
       CASE WHEN game_id % 3 = 0 THEN game_date + 1 ELSE game_date END AS game_date,
       CASE WHEN game_id % 3 = 0 THEN goals + 1 ELSE goals END AS goals
FROM j WHERE raw_position <> 'G'""",
)
def daily_merge(spark, d):
    """S8 on the partitioned fact: all skater lines are landed, then a third of
    the games again with another score and date. A moved line leaves its old
    partition."""
    enriched = I.enrich(Q.log_lines(spark, d), Q.box_lines(spark, d), Q.headers(spark, d), Q.team_names(spark, d))
    store = work_root(spark, "daily-merge")
    facts = U._stage(I.skater_fact(enriched), store, "facts")

    def land(rows, at):
        U.merge_into_partitions(spark, rows.withColumn("landed_at", F.lit(at).cast("timestamp")), store, "player_game_stats")

    land(facts, "2024-01-02 00:00:00")
    again = facts.where(F.col("game_id") % 3 == 0)
    land(again.withColumn("game_date", F.date_add("game_date", 1)).withColumn("goals", F.col("goals") + 1), "2024-01-03 00:00:00")
    return U.read_fact(spark, store, "player_game_stats").select("game_id", "player_id", "season", "game_date", "goals")


# ------------------------------------------------------------ S6, S7, T13
APPEND_FROM = "1996-01-01"
RELANDED_SEASON = "1997"


@register(
    "append_lines",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus FROM lineitem",
)
def append_lines(spark, d):
    """Lines up to a date, then the rest appended to the same partitioned
    table, which then holds every line once."""
    path = f"{work_root(spark, 'append')}/lines"
    li = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_shipdate")
    late = F.coalesce(F.col("l_shipdate") >= F.lit(APPEND_FROM).cast("timestamp_ntz"), F.lit(True))
    for rows in (li.where(~late), li.where(late)):
        ST.append(rows.drop("l_shipdate"), path, partition_by=["l_linestatus"])
    return spark.read.schema("l_orderkey bigint, l_linenumber int, l_quantity double, l_linestatus string").parquet(path)


@register(
    "truncate_reload",
    """SELECT p_partkey, p_name, p_size + 1 AS p_size, (SELECT count(*) FROM part WHERE p_size > 10) AS rows_cleared FROM part""",
)
def truncate_reload(spark, d):
    """Part of the table, then a full reload over it; with the number of
    rows that the reload cleared."""
    path = f"{work_root(spark, 'reload')}/parts"
    parts = S.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    ST.overwrite(parts.where(F.col("p_size") > 10), path)
    cleared = ST.overwrite(parts.withColumn("p_size", F.col("p_size") + 1), path)
    return spark.read.schema(parts.schema).parquet(path).withColumn("rows_cleared", F.lit(cleared).cast("bigint"))


@register(
    "season_seed",
    Q.ENRICH_SQL
    + f"""
SELECT 'skater' AS kind, game_id, player_id, season, CASE WHEN season = '{RELANDED_SEASON}' THEN goals + 1 ELSE goals END AS n
FROM e WHERE raw_position <> 'G'
UNION ALL
SELECT 'goalie', game_id, player_id, season, CASE WHEN season = '{RELANDED_SEASON}' THEN coalesce(saves, 0) + 1 ELSE coalesce(saves, 0) END
FROM e WHERE raw_position = 'G'""",
)
def season_seed(spark, d):
    """Both facts of every season landed, then one season landed again
    with other values; the other seasons stay."""
    root = work_root(spark, "season-seed")
    enriched = U._stage(I.enrich(Q.log_lines(spark, d), Q.box_lines(spark, d), Q.headers(spark, d), Q.team_names(spark, d)), root, "enriched")
    sk, gk = I.skater_fact(enriched), I.goalie_fact(enriched)
    paths = I.land_facts(sk, gk, root)
    again = F.col("season") == RELANDED_SEASON
    I.land_facts(sk.where(again).withColumn("goals", F.col("goals") + 1), gk.where(again).withColumn("saves", F.col("saves") + 1), root)

    def rows(kind, name, fact, value):
        table = spark.read.schema(fact.schema).parquet(paths[name])
        return table.select(F.lit(kind).alias("kind"), "game_id", "player_id", "season", F.col(value).alias("n"))

    return rows("skater", "player_game_stats", sk, "goals").unionByName(rows("goalie", "goalie_game_stats", gk, "saves"))
