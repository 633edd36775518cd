"""Log lines x box-score lines -> the two per-game facts.

One DataFrame plan: a left join of the log to the box-score lines on
(game, player), an inner join to the game header, the opponent rule, two
lookups of team names, scoring, and a split by position into the skater
and goalie facts. The two shuffles are the (game, player) join and the
header join on game; the team map (fixed size) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark import constants as K
from rinkspark import schemas
from rinkspark.functions.scoring import (
    filled,
    goalie_points,
    ot_loss_flag,
    ratio_or_null,
    shutout_flag,
    skater_points,
    toi_to_seconds,
    win_flag,
)
from rinkspark.operators.joins import join_small
from rinkspark.sources.store import conform


def team_map(spark: SparkSession) -> DataFrame:
    """The fixed code -> name table as a DataFrame (32 rows)."""
    return spark.createDataFrame(sorted(K.TEAM_NAMES.items()), "abbrev string, name string")


def team_code_map(spark: SparkSession) -> DataFrame:
    """T10 reverse map: full team name -> code (32 rows)."""
    return spark.createDataFrame(sorted((n, c) for c, n in K.TEAM_NAMES.items()), "name string, abbrev string")


def with_team_code(df: DataFrame, names: DataFrame, *, name_col: str = "team_name", out: str = "team_abbrev") -> DataFrame:
    """T10 reverse lookup: add the code of a full team name (null when the
    name is unknown); the name table is broadcast behind its size check."""
    m = names.select(F.col("name").alias(name_col), F.col("abbrev").alias(out))
    return join_small(df, m, name_col, "left", 10_000)


def opponent(team: str = "team_abbrev", home: str = "home_abbrev", away: str = "away_abbrev"):
    """The away side when the team is home, else the home side (also
    when the team is neither side: that case is counted by
    :func:`unmatched_team_count`)."""
    return F.when(F.col(team) == F.col(home), F.col(away)).otherwise(F.col(home))


def unmatched_team_count(enriched: DataFrame) -> DataFrame:
    """Data-quality count: all lines, and those whose team is neither side of
    the game."""
    bad = (F.col("team_abbrev") != F.col("home_abbrev")) & (F.col("team_abbrev") != F.col("away_abbrev"))
    return enriched.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("unmatched_team_lines"))


def enrich(
    log: DataFrame,
    lines: DataFrame,
    headers: DataFrame,
    names: DataFrame,
    *,
    seasons: DataFrame | None = None,
) -> DataFrame:
    """One enriched row per log line that has a game header.

    ``log``: player_id, game_id, team_abbrev, log_game_date, pp_points,
    sh_points, toi, shifts. ``lines``: box-score lines (see
    ``landed.box_lines``). ``headers``: game_id, home_abbrev, away_abbrev.
    ``names``: abbrev, name. ``seasons``: game_id, season (from the
    schedule row; B7), optional.
    """
    box = lines.select(
        "game_id",
        "player_id",
        "box_name",
        "box_position",
        "goals",
        "assists",
        "shots",
        "blocked_shots",
        "hits",
        "jersey_number",
        "saves",
        "save_pct",
        "goals_against",
        "decision",
    )
    # The game joins come first: lines dealt by game are not moved for them.
    j = log.join(headers, "game_id", "inner")
    if seasons is not None:
        j = j.join(seasons.select("game_id", "season"), "game_id", "left")
    elif "season" not in headers.columns:
        j = j.withColumn("season", F.lit(None).cast("string"))
    j = j.join(box, ["game_id", "player_id"], "left")
    j = j.withColumn("opponent_abbrev", opponent())
    team_names = names.select(F.col("abbrev").alias("team_abbrev"), F.col("name").alias("team_name"))
    opp_names = names.select(F.col("abbrev").alias("opponent_abbrev"), F.col("name").alias("opponent_name"))
    j = join_small(j, team_names, "team_abbrev", "left", 10_000)
    j = join_small(j, opp_names, "opponent_abbrev", "left", 10_000)
    return j.select(
        "game_id",
        "player_id",
        F.try_to_date("log_game_date").alias("game_date"),
        F.col("season").cast("string").alias("season"),
        "team_abbrev",
        F.coalesce("team_name", F.lit(K.UNKNOWN_TEAM)).alias("team_name"),
        "opponent_abbrev",
        F.coalesce("opponent_name", F.lit(K.UNKNOWN_TEAM)).alias("opponent_name"),
        F.coalesce("box_name", F.lit(K.NOT_AVAILABLE)).alias("player_name"),
        "jersey_number",
        F.coalesce("box_position", F.lit(K.NOT_AVAILABLE)).alias("raw_position"),
        filled("goals").alias("goals"),
        filled("assists").alias("assists"),
        filled("pp_points").cast("double").alias("pp_points"),
        filled("sh_points").cast("double").alias("sh_points"),
        filled("shots").alias("shots"),
        filled("blocked_shots").alias("blocked_shots"),
        filled("hits").alias("hits"),
        F.coalesce(F.col("toi"), F.lit("00:00")).alias("toi"),
        filled("shifts").alias("shifts"),
        "saves",
        "save_pct",
        "goals_against",
        "decision",
        "home_abbrev",
        "away_abbrev",
    )


def skater_fact(enriched: DataFrame) -> DataFrame:
    """T11 (skater branch) + F1-F3: every line whose position is not G."""
    s = enriched.where(F.col("raw_position") != K.GOALIE_POSITION)
    out = s.select(
        "*",
        F.col("raw_position").alias("position"),
        ratio_or_null("goals", "shots").alias("shooting_pct"),
        toi_to_seconds("toi").alias("toi_seconds"),
        skater_points().alias("total_fpts"),
    )
    return conform(out, schemas.PLAYER_GAME_STATS)


def goalie_fact(enriched: DataFrame) -> DataFrame:
    """T11 (goalie branch) + F4/F5 + T12: lines whose position is G; flags
    and points from the raw values, then null saves / save pct / goals
    against written as 0."""
    g = enriched.where(F.col("raw_position") == K.GOALIE_POSITION)
    out = g.select(
        "*",
        F.lit(K.GOALIE_LABEL).alias("position"),
        win_flag().alias("wins"),
        shutout_flag().alias("shutouts"),
        ot_loss_flag().alias("ot_losses"),
        goalie_points().alias("total_fpts"),
    )
    out = (
        out.withColumn("saves", filled("saves"))
        .withColumn("save_pct", filled("save_pct", 0.0))
        .withColumn("goals_against", filled("goals_against"))
    )
    return conform(out, schemas.GOALIE_GAME_STATS)


def enriched_lines(spark: SparkSession, log: DataFrame, box: DataFrame, *, seasons: DataFrame | None = None) -> DataFrame:
    """Landed logs + box scores -> enriched lines of both kinds."""
    from rinkspark.sources.landed import box_headers, box_lines

    return enrich(log, box_lines(box), box_headers(box), team_map(spark), seasons=seasons)


def build_facts(
    spark: SparkSession,
    log: DataFrame,
    box: DataFrame,
    *,
    seasons: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Landed logs + box scores -> (skater fact, goalie fact)."""
    enriched = enriched_lines(spark, log, box, seasons=seasons)
    return skater_fact(enriched), goalie_fact(enriched)


def land_facts(skaters: DataFrame, goalies: DataFrame, root: str) -> dict[str, str]:
    """Write both facts partitioned by season in one job each; a
    re-landed season replaces only its own partition (dynamic overwrite),
    so a prior-season job never touches the current season.

    Each task sorts its rows by player and date before writing (no extra
    shuffle), so Parquet min/max statistics let a per-player lookup or
    filter skip most row groups."""
    from rinkspark.sources.store import overwrite_partitions

    out = {}
    for name, df in (("player_game_stats", skaters), ("goalie_game_stats", goalies)):
        path = f"{root}/{name}"
        overwrite_partitions(df.sortWithinPartitions("season", "player_id", "game_date"), path, ["season"])
        out[name] = path
    return out
