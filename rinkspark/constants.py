"""Fixed values of the league domain.

FIXED VALUES: these must equal the source tool's values for results to
match; they are stated plainly, in their natural order, and kept together.
"""

from __future__ import annotations

# --- fixed values: scoring weights, per statistic -------------------------
SKATER_WEIGHTS = {
    "goals": 2.0,
    "assists": 1.0,
    "pp_points": 0.5,
    "sh_points": 0.5,
    "shots": 0.1,
    "blocked_shots": 0.5,
    "hits": 0.1,
}

GOALIE_WEIGHTS = {
    "wins": 4.0,
    "goals_against": -2.0,
    "saves": 0.2,
    "shutouts": 3.0,
    "ot_losses": 1.0,
}

# --- fixed values: codes ---------------------------------------------------
GOALIE_POSITION = "G"
SKATER_POSITIONS = ("C", "L", "R", "D")
GOALIE_LABEL = "Goalie"
REGULAR_SEASON_GAME_TYPE = 2
PLAYOFF_GAME_TYPE = 3
WIN_DECISION = "W"
LOSS_DECISION = "L"
OT_LOSS_DECISION = "O"
UNKNOWN_TEAM = "Unknown"
NOT_AVAILABLE = "N/A"
FREE_AGENT_LABEL = "*** Free Agent ***"
NO_DIFFICULTY = "No difficulty data"

# League calendar: weeks run Monday..Sunday in the league's zone
# (US/Eastern; America/New_York is its canonical tz name).
LEAGUE_TIME_ZONE = "America/New_York"

# Difficulty tiers on the 1-based average rank.
EASY_MAX_RANK = 10
HARD_MIN_RANK = 23

# Hot list defaults.
HOT_WINDOW_DAYS = 14
HOT_MIN_GAMES = 2  # strictly more than this many games
HOT_LIMIT = 100

# --- fixed values: team code -> team name ----------------------------------
TEAM_NAMES = {
    "BOS": "Boston Bruins",
    "BUF": "Buffalo Sabres",
    "CGY": "Calgary Flames",
    "CHI": "Chicago Blackhawks",
    "DET": "Detroit Red Wings",
    "EDM": "Edmonton Oilers",
    "CAR": "Carolina Hurricanes",
    "LAK": "Los Angeles Kings",
    "DAL": "Dallas Stars",
    "MTL": "Montréal Canadiens",
    "NJD": "New Jersey Devils",
    "NYI": "New York Islanders",
    "NYR": "New York Rangers",
    "OTT": "Ottawa Senators",
    "PHI": "Philadelphia Flyers",
    "PIT": "Pittsburgh Penguins",
    "COL": "Colorado Avalanche",
    "SJS": "San Jose Sharks",
    "STL": "St. Louis Blues",
    "TBL": "Tampa Bay Lightning",
    "TOR": "Toronto Maple Leafs",
    "VAN": "Vancouver Canucks",
    "WSH": "Washington Capitals",
    "ANA": "Anaheim Ducks",
    "FLA": "Florida Panthers",
    "NSH": "Nashville Predators",
    "WPG": "Winnipeg Jets",
    "CBJ": "Columbus Blue Jackets",
    "MIN": "Minnesota Wild",
    "VGK": "Vegas Golden Knights",
    "SEA": "Seattle Kraken",
    "UTA": "Utah Hockey Club",
}

# The zero-filled team list is every code above, sorted.
TEAM_CODES = tuple(sorted(TEAM_NAMES))
