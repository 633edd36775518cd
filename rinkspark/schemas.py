"""Declared schemas: the domain tables and the landed JSON payloads.

Nothing is inferred at read time; JSON and CSV are read with these.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- landed schedule --------------------------------------------------------
NAME = _struct(("default", _S), ("fr", _S))
TEAM = _struct(
    ("id", _I),
    ("commonName", NAME),
    ("placeName", NAME),
    ("placeNameWithPreposition", NAME),
    ("abbrev", _S),
    ("logo", _S),
    ("darkLogo", _S),
    ("awaySplitSquad", _B),
    ("score", _I),
)
GAME = _struct(
    ("id", _L),
    ("season", _I),
    ("gameType", _I),
    ("gameDate", _S),
    ("startTimeUTC", _S),
    ("easternUTCOffset", _S),
    ("venueUTCOffset", _S),
    ("venueTimezone", _S),
    ("gameState", _S),
    ("gameScheduleState", _S),
    ("awayTeam", TEAM),
    ("homeTeam", TEAM),
)
# ``landed_at`` (optional, ISO time) is the landing time of the document; the
# file's modification time stands in where it is missing.
SCHEDULE = _struct(("games", T.ArrayType(GAME)), ("landed_at", _S))

# --- landed box score -------------------------------------------------------
LOCALISED = T.MapType(_S, _S)
SIDE = _struct(("abbrev", _S), ("commonName", LOCALISED))
SKATER_LINE = _struct(
    ("playerId", _L),
    ("name", LOCALISED),
    ("position", _S),
    ("goals", _I),
    ("assists", _I),
    ("sog", _I),
    ("blockedShots", _I),
    ("hits", _I),
    ("sweaterNumber", _I),
)
GOALIE_LINE = _struct(
    ("playerId", _L),
    ("name", LOCALISED),
    ("position", _S),
    ("saves", _I),
    ("savePctg", _D),
    ("goalsAgainst", _I),
    ("decision", _S),
    ("sweaterNumber", _I),
)
LINES = _struct(
    ("forwards", T.ArrayType(SKATER_LINE)),
    ("defense", T.ArrayType(SKATER_LINE)),
    ("goalies", T.ArrayType(GOALIE_LINE)),
)
BOXSCORE = _struct(
    ("id", _L),
    ("gameDate", _S),
    ("awayTeam", SIDE),
    ("homeTeam", SIDE),
    ("playerByGameStats", _struct(("awayTeam", LINES), ("homeTeam", LINES))),
    ("landed_at", _S),
)

# --- landed player log ------------------------------------------------------
LOG_ENTRY = _struct(
    ("gameId", _L),
    ("teamAbbrev", _S),
    ("gameDate", _S),
    ("powerPlayPoints", _I),
    ("shorthandedPoints", _I),
    ("toi", _S),
    ("shifts", _I),
    ("pim", _I),
)
PLAYER_LOG = _struct(("player_id", _L), ("gameLog", T.ArrayType(LOG_ENTRY)), ("landed_at", _S))

# --- weekly schedule CSV ------------------------------------------------------
WEEKLY_CSV = _struct(
    ("Team", _S),
    ("Week", _S),
    ("Monday_Date", _S),
    ("Sunday_Date", _S),
    ("Game_Count", _I),
    ("Opponents", _S),
)

# --- tables -------------------------------------------------------------------
TEAM_SCHEDULE = _struct(
    ("id", _L),
    ("team", _S),
    ("week", _S),
    ("monday_date", T.DateType()),
    ("sunday_date", T.DateType()),
    ("game_count", _I),
    ("opponents", _S),
)
FANTASY_TEAM = _struct(
    ("team_id", _L), ("external_team_id", _L), ("team_name", _S), ("owner_name", _S)
)
PRO_PLAYERS = _struct(
    ("player_id", _L),
    ("external_id", _L),
    ("player_name", _S),
    ("team_abbrev", _S),
    ("position", _S),
    ("jersey_number", _I),
    ("is_active", _B),
    ("is_goalie", _B),
    ("injury_status", _S),
    ("fantasy_team_id", _L),
    ("season_games_played", _I),
    ("season_total_fpts", _D),
    ("season_goals", _I),
    ("season_assists", _I),
    ("season_pp_points", _D),
    ("season_sh_points", _D),
    ("season_shots", _I),
    ("season_blocked_shots", _I),
    ("season_hits", _I),
    ("season_wins", _I),
    ("season_shutouts", _I),
    ("season_ot_losses", _I),
    ("season_saves", _I),
    ("season_goals_against", _I),
    ("prior_season_avg_fpts", _D),
    ("prior_season_games_played", _I),
    ("predicted_fpts", _D),
)
_CONTEXT = (
    ("game_id", _L),
    ("player_id", _L),
    ("game_date", T.DateType()),
    ("season", _S),
    ("team_abbrev", _S),
    ("team_name", _S),
    ("opponent_abbrev", _S),
    ("opponent_name", _S),
    ("player_name", _S),
    ("jersey_number", _I),
    ("position", _S),
)
PLAYER_GAME_STATS = _struct(
    *_CONTEXT,
    ("goals", _I),
    ("assists", _I),
    ("pp_points", _D),
    ("sh_points", _D),
    ("shots", _I),
    ("shooting_pct", _D),
    ("blocked_shots", _I),
    ("hits", _I),
    ("toi_seconds", _I),
    ("shifts", _I),
    ("total_fpts", _D),
)
GOALIE_GAME_STATS = _struct(
    *_CONTEXT,
    ("saves", _I),
    ("save_pct", _D),
    ("goals_against", _I),
    ("decision", _S),
    ("wins", _I),
    ("shutouts", _I),
    ("ot_losses", _I),
    ("total_fpts", _D),
)
ROSTER_MOVES = _struct(
    ("move_id", _L),
    ("move_ts", T.TimestampType()),
    ("kind", _S),
    ("team_id", _L),
    ("other_team_id", _L),
    ("send", T.ArrayType(_L)),
    ("receive", T.ArrayType(_L)),
)

TABLES = {
    "team_schedule": (TEAM_SCHEDULE, ("team", "week")),
    "fantasy_team": (FANTASY_TEAM, ("team_id",)),
    "pro_players": (PRO_PLAYERS, ("player_id",)),
    "player_game_stats": (PLAYER_GAME_STATS, ("game_id", "player_id")),
    "goalie_game_stats": (GOALIE_GAME_STATS, ("game_id", "player_id")),
}
