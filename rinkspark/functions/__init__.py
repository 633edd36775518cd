"""Scalar column functions (F1-F17). All return ``Column`` expressions."""

from rinkspark.functions.calendar import (
    league_date,
    local_time,
    matchup_code,
    matchup_items,
    matchup_text,
    parse_instant,
    week_bounds,
    week_bounds_of_key,
    week_end,
    week_key,
    week_key_of_date,
    week_start,
)
from rinkspark.functions.names import clean_name, name_form, player_key, strip_accents
from rinkspark.functions.scoring import (
    display_round,
    filled,
    goalie_points,
    label_or,
    ot_loss_flag,
    ratio_or_null,
    seconds_to_minutes,
    shutout_flag,
    skater_points,
    toi_to_seconds,
    weighted_score,
    win_flag,
)

__all__ = [
    "clean_name",
    "display_round",
    "filled",
    "goalie_points",
    "label_or",
    "league_date",
    "local_time",
    "matchup_code",
    "matchup_items",
    "matchup_text",
    "name_form",
    "ot_loss_flag",
    "parse_instant",
    "player_key",
    "ratio_or_null",
    "seconds_to_minutes",
    "shutout_flag",
    "skater_points",
    "strip_accents",
    "toi_to_seconds",
    "week_bounds",
    "week_bounds_of_key",
    "week_end",
    "week_key",
    "week_key_of_date",
    "week_start",
    "weighted_score",
    "win_flag",
]
