"""Player dimension: latest info, season totals, rebuild and increments (A1-A10).

Per-player "latest row" and totals are aggregates (``max`` of a struct,
``sum``/``count``), so Spark combines them map-side before the shuffle:
a player with a third of all rows costs no more than any other player.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkspark import constants as K
from rinkspark.sources.store import partial_upsert


SKATER_TOTALS = {
    "goals": "season_goals",
    "assists": "season_assists",
    "pp_points": "season_pp_points",
    "sh_points": "season_sh_points",
    "shots": "season_shots",
    "blocked_shots": "season_blocked_shots",
    "hits": "season_hits",
}
GOALIE_TOTALS = {
    "wins": "season_wins",
    "shutouts": "season_shutouts",
    "ot_losses": "season_ot_losses",
    "saves": "season_saves",
    "goals_against": "season_goals_against",
}
INFO_COLUMNS = ("player_name", "team_abbrev", "position", "jersey_number")


def _season(df: DataFrame, season, season_col: str = "season") -> DataFrame:
    return df if season is None else df.where(F.col(season_col) == F.lit(season))


def latest_info(
    fact: DataFrame,
    season=None,
    *,
    columns: Sequence[str] = INFO_COLUMNS,
    order_by: Sequence[str] = ("game_date", "game_id"),
    key: str = "player_id",
    position_label: str | None = None,
    is_goalie: bool | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """A1/A2: per player, the row of the latest game (later date, then the
    higher game id, wins; remaining columns break any tie left).

    ``max(struct(order..., columns...))`` is a partial aggregate: one row per
    player leaves each map task, instead of a window sorting every game.
    ``totals`` (name -> aggregate) are computed in the same pass.
    """
    totals = totals or {}
    cols = [c for c in columns if c in fact.columns]
    present = [c for c in order_by if c in fact.columns]
    best = F.max(F.struct(*[F.col(c) for c in present], *[F.col(c) for c in cols])).alias("_best")
    out = _season(fact, season).groupBy(key).agg(best, *[c.alias(n) for n, c in totals.items()])
    sel = [F.col(key)] + [F.col(f"_best.{c}").alias(f"latest_{c}") for c in present]
    sel += [F.col(f"_best.{c}").alias(c) for c in cols] + [F.col(n) for n in totals]
    out = out.select(*sel)
    if position_label is not None:
        out = out.withColumn("position", F.lit(position_label))
    if is_goalie is not None:
        out = out.withColumn("is_goalie", F.lit(is_goalie))
    return out


def union_with_precedence(preferred: DataFrame, other: DataFrame, key: str | Sequence[str] = "player_id") -> DataFrame:
    """A3: every row of ``preferred`` plus the rows of ``other`` whose key
    ``preferred`` lacks (a goalie entry replaces a skater entry)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = other.join(preferred.select(*keys), keys, "left_anti")
    return preferred.unionByName(rest, allowMissingColumns=True)


def _totals(fact: DataFrame, names: dict[str, str]) -> dict[str, Column]:
    """Games played, total points and the sums of the measures in ``fact``."""
    out = {"season_games_played": F.count("game_id").cast("int"), "season_total_fpts": F.sum("total_fpts")}
    return out | {name: F.sum(m) for m, name in names.items() if m in fact.columns}


def _season_totals(fact: DataFrame, season, key: str, names: dict[str, str]) -> DataFrame:
    return _season(fact, season).groupBy(key).agg(*[c.alias(n) for n, c in _totals(fact, names).items()])


def skater_season_totals(fact: DataFrame, season=None, *, key: str = "player_id") -> DataFrame:
    """A4: games played, total points and the sums of the skater measures."""
    return _season_totals(fact, season, key, SKATER_TOTALS)


def goalie_season_totals(fact: DataFrame, season=None, *, key: str = "player_id") -> DataFrame:
    """A5: games played, total points and the sums of the goalie measures."""
    return _season_totals(fact, season, key, GOALIE_TOTALS)


def season_snapshot(skaters: DataFrame, goalies: DataFrame, season=None) -> DataFrame:
    """A1..A5 combined: one row per player of the season with the latest
    info and the totals, in one pass over each fact; a goalie row wins over a
    skater row."""
    sk = latest_info(skaters, season, is_goalie=False, totals=_totals(skaters, SKATER_TOTALS))
    gk = latest_info(goalies, season, position_label=K.GOALIE_LABEL, is_goalie=True, totals=_totals(goalies, GOALIE_TOTALS))
    return union_with_precedence(gk, sk)


def rebuild_dimension(dim: DataFrame, skaters: DataFrame, goalies: DataFrame, season=None) -> DataFrame:
    """Refresh info and season totals of every player of the season;
    players without games in it keep their row unchanged, roster and
    prior-season columns are kept, new players are added."""
    snap = season_snapshot(skaters, goalies, season).drop("latest_game_date", "latest_game_id")
    update_cols = [c for c in snap.columns if c != "player_id"]
    # An info column only one of the two facts carries must not blank the
    # other kind's value.
    one_sided = [c for c in INFO_COLUMNS if (c in skaters.columns) != (c in goalies.columns)]
    return partial_upsert(dim, snap, "player_id", update_cols, keep_when_null=one_sided)


def incremental_totals(
    totals: DataFrame,
    fact: DataFrame,
    batch: DataFrame,
    *,
    season=None,
    kind: str = "skater",
    key: str = "player_id",
) -> DataFrame:
    """After a batch of new games lands in ``fact``, recompute the totals
    of the players the batch touches from the (deduplicated) fact and upsert
    them. A re-run of the same batch gives the same table (idempotent,
    unlike adding the batch to the old totals)."""
    touched = batch.select(key).distinct()
    scope = fact.join(touched, key, "left_semi")
    fresh = skater_season_totals(scope, season) if kind == "skater" else goalie_season_totals(scope, season)
    cols = [c for c in fresh.columns if c != key]
    return partial_upsert(totals, fresh, key, cols)


def delta_totals(
    totals: DataFrame,
    fresh: DataFrame,
    replaced: DataFrame,
    *,
    kind: str = "skater",
    key: str = "player_id",
) -> DataFrame:
    """A7 without reading history: season totals moved by the batch.

    ``fresh`` holds the batch's fact rows, ``replaced`` the stored rows they
    overwrite (same (game, player) keys, read while merging). New totals =
    old + totals(fresh) - totals(replaced), per player: O(batch) work. A
    re-applied batch replaces exactly the rows it wrote, so the result does
    not change (idempotent, like the recompute in
    :func:`incremental_totals`). A measure stays null while it has no value;
    one whose every value is later replaced by nulls reads 0, not null."""
    agg = skater_season_totals if kind == "skater" else goalie_season_totals
    plus = agg(fresh, key=key)
    minus = agg(replaced, key=key)
    cols = [c for c in plus.columns if c != key]
    signed = plus.unionByName(minus.select(key, *[(-F.col(c)).alias(c) for c in cols]))
    change = signed.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols])
    j = totals.alias("t").join(change.alias("d"), key, "full_outer")
    out = [F.col(key)]
    for c in totals.columns:
        if c == key:
            continue
        if c in cols:
            t, dc = F.col(f"t.{c}"), F.col(f"d.{c}")
            # A sum over no values stays null, as in the recompute.
            moved = F.when(t.isNull() & dc.isNull(), F.lit(None)).otherwise(
                F.coalesce(t, F.lit(0)) + F.coalesce(dc, F.lit(0))
            )
            out.append(moved.cast(totals.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"t.{c}"))
    return j.select(*out)


def prior_season_averages(
    dim: DataFrame,
    skaters: DataFrame,
    goalies: DataFrame,
    prior_season,
    *,
    key: str = "player_id",
) -> DataFrame:
    """Games and average points of the prior season, skater then goalie
    (goalie wins), written only onto players already in ``dim``."""

    def avgs(f):
        return _season(f, prior_season).groupBy(key).agg(
            F.count("game_id").cast("int").alias("_games"), F.avg("total_fpts").alias("_avg")
        )

    both = union_with_precedence(avgs(goalies), avgs(skaters), key)
    out = dim.join(both, key, "left")
    return (
        out.withColumn("prior_season_games_played", F.coalesce("_games", "prior_season_games_played"))
        .withColumn("prior_season_avg_fpts", F.coalesce("_avg", "prior_season_avg_fpts"))
        .drop("_games", "_avg")
    )


def roster_count(players: DataFrame, team_id) -> DataFrame:
    """Number of players on one roster."""
    return players.where(F.col("fantasy_team_id") == F.lit(team_id)).agg(F.count(F.lit(1)).alias("n_players"))


def roster_counts(teams: DataFrame, players: DataFrame) -> DataFrame:
    """A10: players per roster team, 0 kept, ordered by team name.

    Players are counted per team first (map-side partial count), then the
    small per-team result is joined to the team list."""
    per_team = (
        players.where(F.col("fantasy_team_id").isNotNull())
        .groupBy(F.col("fantasy_team_id").alias("team_id"))
        .agg(F.count("player_id").alias("n_players"))
    )
    out = teams.join(per_team, "team_id", "left").select(
        "team_id", "team_name", "owner_name", F.coalesce("n_players", F.lit(0)).alias("n_players")
    )
    return out.orderBy("team_name", "team_id")
