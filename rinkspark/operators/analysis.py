"""League questions over the per-game facts (Q-1..Q-15) and lookups.

Every operator answers for *all* players at once (grouped by player),
with an optional player filter, instead of one query per player. Inputs
are DataFrames with the domain column names by default; every name can be
overridden so the same operator runs over any table of that shape.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinkspark import constants as K
from rinkspark.functions.calendar import matchup_code, matchup_items
from rinkspark.functions.scoring import label_or, seconds_to_minutes

DateLike = dt.date | str | Column


def _date(d: DateLike) -> Column:
    return d if isinstance(d, Column) else F.lit(str(d)).cast("date")


def _season_filter(df: DataFrame, season, season_col: str) -> DataFrame:
    return df if season is None else df.where(F.col(season_col) == F.lit(season))


def _players(df: DataFrame, player_ids, player_col: str) -> DataFrame:
    if player_ids is None:
        return df
    if isinstance(player_ids, DataFrame):
        return df.join(player_ids.select(player_col).distinct(), player_col, "left_semi")
    return df.where(F.col(player_col).isin(list(player_ids)))


# --------------------------------------------------------------------------
# Q-1 .. Q-4: opponent difficulty with an average rank and a tier
# --------------------------------------------------------------------------
def opponent_difficulty(
    fact: DataFrame,
    season=None,
    *,
    opponent: str = "opponent_abbrev",
    points: str = "total_fpts",
    season_col: str = "season",
    out: str = "avg_fpts_allowed",
    by: Sequence[str] = (),
) -> DataFrame:
    """Q-1/Q-2: average points per opponent (optionally per ``by`` keys such
    as season or player kind). Partial + final hash aggregate: a hot
    opponent is pre-aggregated map-side, never shuffled row by row."""
    keys = [*by, opponent]
    return (
        _season_filter(fact, season, season_col)
        .groupBy(*keys)
        .agg(F.avg(points).alias(out))
    )


def average_rank(
    df: DataFrame,
    value: str,
    *,
    partition_by: Sequence[str] = (),
    out: str = "rank",
    ascending: bool = False,
) -> DataFrame:
    """Q-3: 1-based average rank (ties share the mean of their positions),
    cut to an integer, like a pandas ``rank()`` then ``astype(int)``.

    Input is one row per opponent after Q-1, so each rank partition holds at
    most one row per team; pass ``partition_by`` (e.g. season) to rank many
    seasons in parallel.
    """
    order = F.col(value).asc() if ascending else F.col(value).desc()
    w = Window.partitionBy(*partition_by).orderBy(order)
    ties = Window.partitionBy(*partition_by, value)
    first_pos = F.rank().over(w)
    n_tied = F.count(F.lit(1)).over(ties)
    avg_pos = first_pos + (n_tied - 1) / 2.0
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.floor(avg_pos).cast("int")))


def difficulty_tier(rank: str | Column = "rank") -> Column:
    """Q-4: rank <= 10 Easy, >= 23 Hard, else Average."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return (
        F.when(r <= K.EASY_MAX_RANK, F.lit("Easy"))
        .when(r >= K.HARD_MIN_RANK, F.lit("Hard"))
        .otherwise(F.lit("Average"))
    )


def ranked_difficulty(fact: DataFrame, season=None, *, by: Sequence[str] = (), **kw) -> DataFrame:
    """Q-1..Q-4 together: average, average rank, tier."""
    out = kw.get("out", "avg_fpts_allowed")
    diff = opponent_difficulty(fact, season, by=by, **kw)
    return average_rank(diff, out, partition_by=by).withColumn("difficulty", difficulty_tier("rank"))


# --------------------------------------------------------------------------
# Q-5, Q-6: this week's schedule and the matchup outlook
# --------------------------------------------------------------------------
def team_week(schedule: DataFrame, team: str | Column, week: str | Column) -> DataFrame:
    """Q-5: the schedule row of a team for a week."""
    t = F.lit(team) if isinstance(team, str) else team
    w = F.lit(week) if isinstance(week, str) else week
    return schedule.where((F.col("team") == t) & (F.col("week") == w))


def matchup_outlook(
    players: DataFrame,
    schedule: DataFrame,
    difficulty: DataFrame,
    week: str | Column,
    *,
    player_team: str = "team_abbrev",
    kind: str = "is_goalie",
    value: str = "avg_fpts_allowed",
) -> DataFrame:
    """Q-6: for each player, one row per opponent of the week, with the
    opponent's rank, tier and average from the difficulty table of the
    player's kind. Missing opponent -> ``No difficulty data``.

    ``difficulty`` has columns (``kind``, opponent_abbrev, ``value``, rank);
    one row per team and kind.
    """
    w = F.lit(week) if isinstance(week, str) else week
    week_rows = schedule.where(F.col("week") == w).select(
        F.col("team").alias(player_team), "week", "game_count", "opponents"
    )
    exploded = (
        players.join(week_rows, player_team, "inner")
        .select(
            "player_id",
            player_team,
            kind,
            "week",
            "game_count",
            F.posexplode(matchup_items("opponents")).alias("slot", "matchup"),
        )
        .withColumn("opponent_abbrev", matchup_code("matchup"))
    )
    diff = difficulty.select(kind, "opponent_abbrev", value, "rank")
    # Derived table (one row per team and kind): AQE broadcasts it at run
    # time from its materialised size; no extra pass to count it.
    joined = exploded.join(diff, [kind, "opponent_abbrev"], "left")
    return joined.withColumn(
        "difficulty",
        F.when(F.col("rank").isNull(), F.lit(K.NO_DIFFICULTY)).otherwise(difficulty_tier("rank")),
    )


# --------------------------------------------------------------------------
# Q-7 .. Q-13: per-player baselines, form and history
# --------------------------------------------------------------------------
def skater_baseline(
    fact: DataFrame,
    players: DataFrame,
    season=None,
    *,
    player_ids=None,
    season_col: str = "season",
) -> DataFrame:
    """Q-7: games, average points / goals / assists / shots and minutes of
    ice time, with the name from the dimension (inner join)."""
    f = _players(_season_filter(fact, season, season_col), player_ids, "player_id")
    per_player = f.groupBy("player_id").agg(
        F.count("game_id").alias("games_played"),
        F.avg("total_fpts").alias("avg_fpts"),
        F.avg("goals").alias("avg_g"),
        F.avg("assists").alias("avg_a"),
        F.avg("shots").alias("avg_sog"),
        seconds_to_minutes(F.avg("toi_seconds")).alias("avg_toi_min"),
    )
    return per_player.join(players.select("player_id", "player_name"), "player_id", "inner")


def peripheral_floor(
    fact: DataFrame,
    season=None,
    *,
    player_ids=None,
    hits: str = "hits",
    blocks: str = "blocked_shots",
    season_col: str = "season",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Q-8: average hits, average blocks, and their weighted sum."""
    w = weights or {"hits": K.SKATER_WEIGHTS["hits"], "blocks": K.SKATER_WEIGHTS["blocked_shots"]}
    f = _players(_season_filter(fact, season, season_col), player_ids, "player_id")
    agg = f.groupBy("player_id").agg(
        F.avg(hits).alias("avg_hits"), F.avg(blocks).alias("avg_blocks")
    )
    return agg.withColumn(
        "avg_peripheral_fpts",
        F.col("avg_hits") * F.lit(w["hits"]) + F.col("avg_blocks") * F.lit(w["blocks"]),
    )


def recent_form(
    fact: DataFrame,
    as_of: DateLike,
    *,
    days: int = K.HOT_WINDOW_DAYS,
    season=None,
    player_ids=None,
    date_col: str = "game_date",
    season_col: str = "season",
    extra_avgs: dict[str, str] | None = None,
) -> DataFrame:
    """Q-9/Q-12: games and average points since ``as_of - days`` (inclusive,
    no upper bound). Goalies pass ``extra_avgs={"save_pct":
    "save_pct_last_14_days"}``."""
    f = _players(_season_filter(fact, season, season_col), player_ids, "player_id")
    f = f.where(F.col(date_col) >= F.date_sub(_date(as_of), days))
    aggs = [
        F.count("game_id").alias("games_last_14_days"),
        F.avg("total_fpts").alias("avg_fpts_last_14_days"),
    ]
    aggs += [F.avg(c).alias(a) for c, a in (extra_avgs or {}).items()]
    return f.groupBy("player_id").agg(*aggs)


def history_vs_opponent(
    fact: DataFrame,
    *,
    player_ids=None,
    opponent: str = "opponent_abbrev",
    extra_avgs: dict[str, str] | None = None,
) -> DataFrame:
    """Q-10/Q-13: per player and opponent over all seasons: games and
    average points (goalies add average save pct)."""
    f = _players(fact, player_ids, "player_id")
    aggs = [F.count("game_id").alias("games_against"), F.avg("total_fpts").alias("avg_fpts_against")]
    aggs += [F.avg(c).alias(a) for c, a in (extra_avgs or {}).items()]
    return f.groupBy("player_id", opponent).agg(*aggs)


def goalie_baseline(
    fact: DataFrame,
    players: DataFrame,
    season=None,
    *,
    player_ids=None,
    season_col: str = "season",
) -> DataFrame:
    """Q-11: games, average points / saves / save pct, total wins and
    shutouts, with the name from the dimension."""
    f = _players(_season_filter(fact, season, season_col), player_ids, "player_id")
    per_player = f.groupBy("player_id").agg(
        F.count("game_id").alias("games_played"),
        F.avg("total_fpts").alias("avg_fpts"),
        F.avg("saves").alias("avg_saves"),
        F.avg("save_pct").alias("avg_save_pct"),
        F.sum("wins").alias("total_wins"),
        F.sum("shutouts").alias("total_shutouts"),
    )
    return per_player.join(players.select("player_id", "player_name"), "player_id", "inner")


def player_report(
    players: DataFrame,
    baseline: DataFrame,
    recent: DataFrame,
    history: DataFrame,
    *,
    floor: DataFrame | None = None,
    opponent: str = "opponent_abbrev",
) -> DataFrame:
    """Q-14: one wide row per player: baseline columns, optional floor,
    recent form (null when no recent game) and the history against every
    opponent as an array of structs sorted by average points, descending.

    The history array is per player and bounded by the number of teams.
    """
    hist = history.groupBy("player_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("avg_fpts_against").alias("avg_fpts_against"),
                    F.col(opponent).alias(opponent),
                    F.col("games_against").alias("games_against"),
                )
            ),
            asc=False,
        ).alias("history")
    )
    base = baseline.drop("player_name") if "player_name" in players.columns else baseline
    out = players.join(base, "player_id", "left")
    if floor is not None:
        out = out.join(floor, "player_id", "left")
    return out.join(recent, "player_id", "left").join(hist, "player_id", "left")


def full_report(
    players: DataFrame,
    skaters: DataFrame,
    goalies: DataFrame,
    schedule: DataFrame,
    week: str,
    as_of: DateLike,
    season,
    *,
    difficulty: DataFrame | None = None,
) -> DataFrame:
    """Q-14 whole: one row per player of ``players`` (player_id, player_name,
    team_abbrev, is_goalie) with every part of the report as a nested column:

    - ``week``: the week's games in order, each with its opponent's average,
      rank and tier for the player's kind (null: no schedule for the team);
    - ``skater_baseline`` and ``floor``, or ``goalie_baseline`` (Q-7, Q-8,
      Q-11), null for the other kind and without games;
    - ``recent``: form of the last days (null without a game);
    - ``history``: every opponent over all seasons, best average first.

    ``difficulty`` (is_goalie, opponent_abbrev, avg_fpts_allowed, rank) is
    computed from the facts of ``season`` if it is not given. Parts are
    aggregates per player joined on the player; the arrays are bounded by the
    games of a week and by the teams.
    """
    if difficulty is None:
        both = opponent_difficulty(skaters, season).withColumn("is_goalie", F.lit(False))
        both = both.unionByName(opponent_difficulty(goalies, season).withColumn("is_goalie", F.lit(True)))
        difficulty = average_rank(both, "avg_fpts_allowed", partition_by=["is_goalie"])
    who = players.select("player_id", "player_name", "team_abbrev", "is_goalie")
    game = F.struct("slot", "matchup", "opponent_abbrev", "avg_fpts_allowed", "rank", "difficulty")
    outlook = matchup_outlook(who, schedule, difficulty, week)
    outlook = outlook.groupBy("player_id").agg(F.sort_array(F.collect_list(game)).alias("week"))

    def nested(df: DataFrame, name: str) -> DataFrame:
        parts = [c for c in df.columns if c not in ("player_id", "player_name")]
        return df.select("player_id", F.struct(*parts).alias(name))

    def kind(fact: DataFrame, goalie: bool, parts: list[DataFrame], save_pct: Column) -> DataFrame:
        mine = who.where(F.col("is_goalie") == F.lit(goalie))
        extra = ({"save_pct": "avg_save_pct_last_14_days"}, {"save_pct": "avg_save_pct_against"}) if goalie else (None, None)
        recent = recent_form(fact, as_of, season=season, extra_avgs=extra[0])
        hist = history_vs_opponent(fact, extra_avgs=extra[1])
        if not goalie:
            recent = recent.withColumn("avg_save_pct_last_14_days", save_pct)
            hist = hist.withColumn("avg_save_pct_against", save_pct)
        row = F.struct("avg_fpts_against", "opponent_abbrev", "games_against", "avg_save_pct_against")
        hist = hist.groupBy("player_id").agg(F.sort_array(F.collect_list(row), asc=False).alias("history"))
        for part in [*parts, nested(recent, "recent"), hist]:
            mine = mine.join(part, "player_id", "left")
        return mine

    null = F.lit(None).cast("double")
    sk = kind(skaters, False, [nested(skater_baseline(skaters, who, season), "skater_baseline"), nested(peripheral_floor(skaters, season), "floor")], null)
    gk = kind(goalies, True, [nested(goalie_baseline(goalies, who, season), "goalie_baseline")], null)
    return sk.unionByName(gk, allowMissingColumns=True).join(outlook, "player_id", "left")


# --------------------------------------------------------------------------
# Q-15: hot list
# --------------------------------------------------------------------------
def hot_list(
    fact: DataFrame,
    players: DataFrame,
    teams: DataFrame,
    as_of: DateLike,
    *,
    season=None,
    days: int = K.HOT_WINDOW_DAYS,
    min_games: int = K.HOT_MIN_GAMES,
    limit: int | None = K.HOT_LIMIT,
    free_agents_only: bool = False,
    date_col: str = "game_date",
    season_col: str = "season",
) -> DataFrame:
    """Q-15: players with more than ``min_games`` games since
    ``as_of - days``, by average points, descending, top ``limit``.

    The fact is aggregated per player *before* the dimension joins (the
    join keys are the group key), so the shuffle carries one row per player
    rather than one per game, and the final ORDER BY + LIMIT plans as a
    TakeOrderedAndProject (per-partition top-k, then a k-row merge).
    """
    f = _season_filter(fact, season, season_col).where(
        F.col(date_col) >= F.date_sub(_date(as_of), days)
    )
    per_player = (
        f.groupBy("player_id")
        .agg(
            F.count("game_id").alias("games_last_14"),
            F.avg("total_fpts").alias("avg_fpts_last_14"),
        )
        .where(F.col("games_last_14") > min_games)
    )
    dim = players.select("player_id", "player_name", "team_abbrev", "position", "fantasy_team_id")
    if free_agents_only:
        dim = dim.where(F.col("fantasy_team_id").isNull())
    roster_teams = teams.select(
        F.col("team_id").alias("fantasy_team_id"), F.col("team_name").alias("fantasy_team_name")
    )
    out = (
        per_player.join(dim, "player_id", "inner")
        .join(roster_teams, "fantasy_team_id", "left")
        .select(
            "player_id",
            "player_name",
            "team_abbrev",
            "position",
            label_or("fantasy_team_name").alias("fantasy_team"),
            "games_last_14",
            "avg_fpts_last_14",
        )
    )
    ordered = out.orderBy(F.col("avg_fpts_last_14").desc(), F.col("player_id").asc())
    return ordered.limit(limit) if limit is not None else ordered


# --------------------------------------------------------------------------
# L1 .. L9: lookups and predicates
# --------------------------------------------------------------------------
def player_by_id(players: DataFrame, player_id) -> DataFrame:
    """L1."""
    return players.where(F.col("player_id") == F.lit(player_id))


def free_agents(players: DataFrame) -> DataFrame:
    """L2 (intended behaviour: ``fantasy_team_id IS NULL``)."""
    return players.where(F.col("fantasy_team_id").isNull())


def team_by_name(teams: DataFrame, name: str) -> DataFrame:
    """L3: exact name match."""
    return teams.where(F.col("team_name") == F.lit(name))


def roster_of(players: DataFrame, team_id) -> DataFrame:
    """L4: players of a roster team, by name."""
    return players.where(F.col("fantasy_team_id") == F.lit(team_id)).orderBy("player_name", "player_id")


def game_log(fact: DataFrame, player_id, *, date_col: str = "game_date") -> DataFrame:
    """A player's games, newest first (game id breaks ties)."""
    return fact.where(F.col("player_id") == F.lit(player_id)).orderBy(
        F.col(date_col).desc(), F.col("game_id").desc()
    )


def stats_on_date(skaters: DataFrame, goalies: DataFrame, on: DateLike, *, date_col: str = "game_date") -> DataFrame:
    """All lines of one date, skaters and goalies, with a ``kind``."""
    d = _date(on)
    s = skaters.where(F.col(date_col) == d).withColumn("kind", F.lit("skater"))
    g = goalies.where(F.col(date_col) == d).withColumn("kind", F.lit("goalie"))
    return s.unionByName(g, allowMissingColumns=True)


def search_players(
    players: DataFrame,
    term: str,
    *,
    name_col: str = "player_name",
    free_agents_only: bool = False,
    wildcards: bool = False,
) -> DataFrame:
    """Case-insensitive substring search (Unicode-aware ``lower``).
    ``wildcards=True`` keeps the SQL LIKE reading where ``%`` and ``_``
    are wildcards."""
    name = F.lower(F.col(name_col))
    t = F.lower(F.lit(term))
    cond = F.like(name, F.concat(F.lit("%"), t, F.lit("%"))) if wildcards else name.contains(t)
    out = players.where(cond)
    return free_agents(out) if free_agents_only else out


def search_many(
    players: DataFrame,
    terms: DataFrame,
    *,
    name_col: str = "player_name",
    term_col: str = "term",
    max_broadcast_terms: int = 256,
    gram: int = 3,
) -> DataFrame:
    """L8, batch form: every (distinct term, player) pair where the
    lower-cased name contains the lower-cased term.

    A term list proven to hold at most ``max_broadcast_terms`` rows is the
    broadcast side of a nested-loop join: names x terms JVM ``contains``
    checks, cheap for a short list. A longer list takes an exact equi-join
    path instead (:func:`_search_by_grams`), whose work grows with the names'
    length rather than names x terms, so there is no cap on the number of
    terms."""
    from rinkspark.operators.joins import has_at_most

    # An empty term is not a search: it is dropped (it would match every name).
    t = (
        terms.select(F.col(term_col), F.lower(F.col(term_col)).alias("_lt"))
        .where(F.length("_lt") > 0)
        .dropDuplicates([term_col])
    )
    if has_at_most(t, max_broadcast_terms):
        return players.join(F.broadcast(t), F.lower(F.col(name_col)).contains(F.col("_lt")), "inner").drop("_lt")
    return _search_by_grams(players, t, name_col=name_col, term_col=term_col, gram=gram)


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of length ``n`` of ``text``."""
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    )


def _search_by_grams(players: DataFrame, t: DataFrame, *, name_col: str, term_col: str, gram: int) -> DataFrame:
    """Exact substring search as equi-joins, for term lists too long to
    broadcast in a nested loop.

    The names' pieces are many times the names, which Spark's size estimate of
    an ``explode`` does not see: it would send them to the driver. So the terms
    are the broadcast side when their number is proven small, and no piece
    table is broadcast beyond.

    * A term of length m < ``gram`` matches exactly when it equals one of the
      name's substrings of length m: join on (substring) equality.
    * A longer term contains ``gram``-letter pieces; every name containing
      the term contains its rarest piece. Piece frequencies over all names
      pick that piece per term, the join on it yields candidates, and
      ``contains`` keeps the true matches.
    """
    from rinkspark.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, has_at_most

    how = "broadcast" if has_at_most(t, DEFAULT_MAX_BROADCAST_ROWS) else "merge"
    name = F.lower(F.col(name_col))
    cols = players.columns
    short = t.where(F.length("_lt") < gram)
    long_ = t.where(F.length("_lt") >= gram)

    # short terms: names exploded into their substrings of length 1..gram-1
    subs = F.array_distinct(F.flatten(F.array(*[_grams(name, k) for k in range(1, gram)])))
    name_subs = players.select(*cols, F.explode(subs).alias("_lt"))
    short_hits = name_subs.join(short.hint(how), "_lt", "inner")

    # long terms: rarest piece, then candidates, then verification
    name_grams = players.select(*cols, F.explode(_grams(name, gram)).alias("_g"))
    freq = name_grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    term_grams = long_.select(term_col, "_lt", F.explode(_grams(F.col("_lt"), gram)).alias("_g"))
    rarest = (
        term_grams.join(freq.hint("merge"), "_g", "left")
        .groupBy(term_col, "_lt")
        .agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_g").alias("g"))).alias("_r"))
        .select(term_col, "_lt", F.col("_r.g").alias("_g"))
    )
    long_hits = name_grams.join(rarest.hint(how), "_g", "inner").where(F.lower(F.col(name_col)).contains(F.col("_lt")))
    keep = [*cols, term_col]
    return short_hits.select(*keep).unionByName(long_hits.select(*keep))


def teams_by_name(teams: DataFrame) -> DataFrame:
    """L9."""
    return teams.orderBy("team_name", "team_id")
