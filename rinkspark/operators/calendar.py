"""Calendar and schedule operators.

Input is a games frame with at least ``game_id``, a UTC start instant and
the home / away team codes. Every "today" is an explicit ``as_of`` date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark.functions.calendar import (
    league_date,
    matchup_text,
    week_bounds_of_key,
    week_end,
    week_key_of_date,
)
from rinkspark.operators.analysis import DateLike, _date


def games_by_date(games: DataFrame, *, ts_col: str = "start_time_utc", out: str = "game_date") -> DataFrame:
    """Re-index games by their league-zone date (a column, not a driver
    dict; grouping by date is then an ordinary partition or filter)."""
    return games.withColumn(out, league_date(ts_col))


def past_games(games: DataFrame, as_of: DateLike, *, date_col: str = "game_date") -> DataFrame:
    """Games strictly before ``as_of`` in date order; games whose date
    did not parse (null) are skipped."""
    return games.where(F.col(date_col).isNotNull() & (F.col(date_col) < _date(as_of))).orderBy(
        date_col, "game_id"
    )


def past_future_counts(games: DataFrame, as_of: DateLike, *, date_col: str = "game_date") -> DataFrame:
    """C2 counts: one row with the number of past, future and undated games."""
    d = F.col(date_col)
    a = _date(as_of)
    return games.agg(
        F.count_if(d < a).alias("n_past"),
        F.count_if(d >= a).alias("n_future"),
        F.count_if(d.isNull()).alias("n_undated"),
    )


def yesterday_games(games: DataFrame, as_of: DateLike, *, date_col: str = "game_date") -> DataFrame:
    """Games on the league date before ``as_of``."""
    return games.where(F.col(date_col) == F.date_sub(_date(as_of), 1))


def team_games(
    games: DataFrame,
    *,
    home: str = "home_abbrev",
    away: str = "away_abbrev",
    ts_col: str = "start_time_utc",
    date_col: str = "game_date",
) -> DataFrame:
    """Each game once for the home side and once for the away side
    (``vs AWY`` / ``@ HOM``): a two-element explode, no self-join."""
    sides = F.array(
        F.struct(F.col(home).alias("team"), F.col(away).alias("opponent"), F.lit(True).alias("is_home")),
        F.struct(F.col(away).alias("team"), F.col(home).alias("opponent"), F.lit(False).alias("is_home")),
    )
    return games.select("game_id", ts_col, date_col, F.explode(sides).alias("s")).select(
        "game_id", ts_col, date_col, "s.team", "s.opponent", "s.is_home"
    )


def _ordered_join(label: Column, ts_col: str) -> Column:
    """Labels of a group joined with ``", "`` in (start time, game id) order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(ts_col), F.col("game_id"), label.alias("label"))))
    return F.array_join(F.transform(items, lambda x: x["label"]), ", ")


def weekly_schedule(games: DataFrame, *, ts_col: str = "start_time_utc", date_col: str = "game_date") -> DataFrame:
    """C4 + C5: per team and ISO week of the league date: number of games,
    the opponents in time order, and the week's Monday and Sunday.

    One shuffle on (team, week). The opponents list is the output itself, so
    each group holds exactly the games of one team in one week.
    """
    tg = team_games(games, ts_col=ts_col, date_col=date_col).withColumn("week", week_key_of_date(date_col))
    agg = tg.groupBy("team", "week").agg(
        F.count(F.lit(1)).cast("int").alias("game_count"),
        _ordered_join(matchup_text("is_home", "opponent"), ts_col).alias("opponents"),
    )
    monday, sunday = week_bounds_of_key("week")
    return agg.select(
        "team",
        "week",
        monday.alias("monday_date"),
        sunday.alias("sunday_date"),
        "game_count",
        "opponents",
    )


def remaining_games(
    games: DataFrame,
    as_of: DateLike,
    teams: DataFrame | None = None,
    *,
    ts_col: str = "start_time_utc",
    date_col: str = "game_date",
    team_col: str = "team",
) -> DataFrame:
    """C6 + C7 + C8: games from ``as_of`` through that week's Sunday (both
    inclusive), per team, as ``vs X (date)`` / ``@ X (date)`` in date
    order. With ``teams`` (one row per team code), teams without a game are
    kept with 0 games and an empty list."""
    a = _date(as_of)
    window = games.where((F.col(date_col) >= a) & (F.col(date_col) <= week_end(a)))
    tg = team_games(window, ts_col=ts_col, date_col=date_col)
    label = matchup_text("is_home", "opponent", date_col)
    items = F.array_sort(F.collect_list(F.struct(F.col(date_col), F.col(ts_col), F.col("game_id"), label.alias("label"))))
    per_team = tg.groupBy(F.col("team").alias(team_col)).agg(
        F.count(F.lit(1)).cast("int").alias("n_games"),
        F.transform(items, lambda x: x["label"]).alias("games"),
    )
    if teams is None:
        return per_team
    all_teams = teams.select(team_col).distinct()
    out = all_teams.join(per_team, team_col, "left")
    return out.select(
        team_col,
        F.coalesce("n_games", F.lit(0)).alias("n_games"),
        F.coalesce("games", F.array().cast("array<string>")).alias("games"),
    )


def week_frame(as_of: DateLike) -> tuple[Column, Column]:
    """Monday and Sunday around ``as_of``."""
    from rinkspark.functions.calendar import week_start

    a = _date(as_of)
    return week_start(a), week_end(a)


def league_teams(spark) -> DataFrame:
    """C7's zero-fill list: every team code of the league (fixed values)."""
    from rinkspark import constants as K

    return spark.createDataFrame([(t,) for t in K.TEAM_CODES], "team string")


def weekly_schedule_table(games: DataFrame, **kw) -> DataFrame:
    """C5 as the ``team_schedule`` table: the weekly rows with a surrogate
    ``id`` numbered 1..N in (team, week) order.

    Ids are dense without a global sort: row numbers within each team, plus
    per-team offsets from a window over the per-team counts (one row per
    team)."""
    from pyspark.sql import Window

    rows = weekly_schedule(games, **kw)
    local = rows.withColumn("_n", F.row_number().over(Window.partitionBy("team").orderBy("week")))
    per_team = rows.groupBy("team").agg(F.count(F.lit(1)).alias("_c"))
    offsets = per_team.select(
        "team",
        F.coalesce(F.sum("_c").over(Window.orderBy("team").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "_off"
        ),
    )
    out = local.join(offsets, "team", "inner")
    return out.select(
        (F.col("_off") + F.col("_n")).cast("bigint").alias("id"),
        "team",
        "week",
        "monday_date",
        "sunday_date",
        "game_count",
        "opponents",
    )


def reload_weekly_schedule(games: DataFrame, path: str) -> int:
    """C5 + S7: truncate and reload the weekly table; returns the number of
    rows cleared."""
    from rinkspark.sources.store import overwrite

    return overwrite(weekly_schedule_table(games).sortWithinPartitions("team", "week"), path)
