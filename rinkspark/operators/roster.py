"""Roster moves as a batch against a snapshot.

A move table is applied to the player snapshot as if its moves were made one
by one, by (move_ts, move_id); moves without a time come last:

    kind   players                      valid when
    add    ``receive`` -> team_id       player is a free agent
    drop   ``send`` from team_id        player is on team_id
    trade  ``send`` team_id -> other,   teams differ, both sides non-empty,
           ``receive`` other -> team_id every player is on its sending team

A move needs its teams (not null, and in the team table when one is given),
names a player once, and has an id of its own: moves with a null id or with one
that another move has are rejected. A move is all or nothing, and one that is
rejected changes nothing for those after it.

The batch runs in rounds of aggregates, not move by move. As long as a player
stays on a team, moves that need it elsewhere fail, so each player has one next
move: the earliest open one that needs its present team. Open moves before that
one fail; a move that is the next one of all its players is accepted; players
move on. The earliest open move is always decided, and a round decides one step
of every player, so there are as many rounds as the longest chain of moves that
depend on each other. Next moves are ``min`` per player and decisions ``min`` /
``max`` per move, combined map-side, so a player or a move named very often is
one row per task. A round's open rows and teams are written once (reliable
checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.operators.joins import join_small
from rinkspark.session import cut_lineage

# Reason codes; a move reports the first of its failing rows, an unknown team
# only if nothing else is wrong.
REASONS = ("invalid_move", "unknown_player", "wrong_team", "conflict", "unknown_team")
_INVALID, _UNKNOWN_PLAYER, _WRONG_TEAM, _CONFLICT, _UNKNOWN_TEAM = range(5)
_ROWS_TYPE = "array<struct<player_id:bigint,from_team:bigint,to_team:bigint>>"


def move_rows(moves: DataFrame) -> DataFrame:
    """One row per (move, player) with the team it leaves and joins."""
    send = F.coalesce(F.col("send"), F.array().cast("array<bigint>"))
    recv = F.coalesce(F.col("receive"), F.array().cast("array<bigint>"))

    def side(arr, from_team, to_team):
        return F.transform(
            arr,
            lambda p: F.struct(
                p.cast("bigint").alias("player_id"),
                from_team.cast("bigint").alias("from_team"),
                to_team.cast("bigint").alias("to_team"),
            ),
        )

    null = F.lit(None).cast("bigint")
    rows = (
        F.when(F.col("kind") == "add", side(recv, null, F.col("team_id")))
        .when(F.col("kind") == "drop", side(send, F.col("team_id"), null))
        .when(
            F.col("kind") == "trade",
            F.concat(
                side(send, F.col("team_id"), F.col("other_team_id")),
                side(recv, F.col("other_team_id"), F.col("team_id")),
            ),
        )
    )
    structural = (
        F.when(
            F.col("kind") == "trade",
            (F.col("team_id") != F.col("other_team_id")) & (F.size(send) > 0) & (F.size(recv) > 0),
        )
        .when(F.col("kind") == "add", F.col("team_id").isNotNull() & (F.size(recv) > 0))
        .when(F.col("kind") == "drop", F.col("team_id").isNotNull() & (F.size(send) > 0))
        .otherwise(F.lit(False))
    )
    # A player named twice would be moved twice.
    named = F.when(F.col("kind") == "add", recv).when(F.col("kind") == "drop", send).otherwise(F.concat(send, recv))
    structural = structural & (F.size(F.array_distinct(named)) == F.size(named))
    base = moves.select(
        "move_id",
        "move_ts",
        "kind",
        F.coalesce(structural, F.lit(False)).alias("structural_ok"),
        # A move with no player keeps one row (null player) so it gets a decision.
        F.explode_outer(F.coalesce(rows, F.array().cast(_ROWS_TYPE))).alias("r"),
    )
    return base.select("move_id", "move_ts", "kind", "structural_ok", "r.player_id", "r.from_team", "r.to_team")


def _next_round(open_rows: DataFrame, teams_now: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (decided moves: move_id, accepted; rows still open; the
    players' teams after it)."""
    placed = open_rows.join(teams_now, "player_id")
    fits = F.col("from_team").eqNullSafe(F.col("team_now"))
    nxt = placed.groupBy("player_id").agg(F.min(F.when(fits, F.col("at"))).alias("next_at"))
    seen = open_rows.join(nxt, "player_id").withColumns(
        {"fails": F.col("next_at").isNull() | (F.col("at") < F.col("next_at")), "ready": F.col("at") == F.col("next_at")}
    )
    per_move = seen.groupBy("move_id").agg(F.max("fails").alias("fails"), F.min(F.coalesce("ready", F.lit(False))).alias("ready"))
    judged = cut_lineage(open_rows.join(per_move, "move_id"))
    decided = judged.where("fails OR ready").select("move_id", F.col("ready").alias("accepted")).distinct()
    moved = judged.where("ready").select("player_id", F.col("to_team").alias("_to"), F.lit(True).alias("_moved"))
    teams_next = teams_now.join(moved, "player_id", "left").select("player_id", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("team_now")).alias("team_now"))
    return decided, judged.where("NOT fails AND NOT ready").drop("fails", "ready"), cut_lineage(teams_next)


def apply_roster_moves(players: DataFrame, moves: DataFrame, teams: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """R2-R4 as one batch. Returns (players after the batch, decisions).

    ``players``: player_id, fantasy_team_id (null = free agent), other
    columns kept. ``teams``: team_id; with it, a move that names another team
    is rejected. ``decisions``: move_id, kind, accepted, reason, one row per
    move. A rejected move's reason is the first that holds: it is malformed,
    a player is unknown, a player was not on the team before the batch, an
    earlier move of the batch took a player, a team is unknown.
    """
    ids = moves.groupBy("move_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("move_id").isNotNull() & (F.col("_n") == 1)).select("move_id")
    named = cut_lineage(moves.join(ids, "move_id", "left_semi"))
    nameless = moves.where("move_id IS NULL").unionByName(moves.join(ids, "move_id", "left_anti").where("move_id IS NOT NULL"))

    rows = move_rows(named)
    if teams is not None:
        for side in ("from_team", "to_team"):
            known_team = teams.select(F.col("team_id").alias(side), F.lit(True).alias(f"_{side}_known")).distinct()
            rows = join_small(rows, known_team, side, "left")
        team_missing = (F.col("from_team").isNotNull() & F.col("_from_team_known").isNull()) | (F.col("to_team").isNotNull() & F.col("_to_team_known").isNull())
        rows = rows.withColumn("team_missing", team_missing).drop("_from_team_known", "_to_team_known")
    else:
        rows = rows.withColumn("team_missing", F.lit(False))
    snap = players.select("player_id", F.col("fantasy_team_id").cast("bigint").alias("team_before"), F.lit(True).alias("_known"))
    rows = rows.join(snap, "player_id", "left").withColumns(
        {
            "static": F.when(~F.col("structural_ok") | F.col("player_id").isNull(), F.lit(_INVALID))
            .when(F.col("_known").isNull(), F.lit(_UNKNOWN_PLAYER))
            .when(F.col("team_missing"), F.lit(_UNKNOWN_TEAM)),
            "elsewhere": ~F.col("team_before").eqNullSafe(F.col("from_team")),
        }
    )
    rows = cut_lineage(rows.drop("team_missing", "_known", "structural_ok"))
    own = rows.groupBy("move_id").agg(F.min("static").alias("static"), F.max("elsewhere").alias("elsewhere"))
    passing = own.where("static IS NULL").select("move_id")

    at = F.struct(F.col("move_ts").isNull().alias("late"), "move_ts", "move_id").alias("at")
    open_rows = rows.join(passing, "move_id", "left_semi").select("move_id", at, "player_id", "from_team", "to_team")
    teams_now = rows.join(passing, "move_id", "left_semi").select("player_id", F.col("team_before").alias("team_now")).distinct()
    open_rows, teams_now = cut_lineage(open_rows), cut_lineage(teams_now)
    decided = None
    while not open_rows.isEmpty():
        done, open_rows, teams_now = _next_round(open_rows, teams_now)
        decided = done if decided is None else decided.unionByName(done)
    if decided is None:
        decided = passing.withColumn("accepted", F.lit(False))  # no rows

    reasons = F.array(*[F.lit(x) for x in REASONS])
    late = F.when(F.col("elsewhere"), F.lit(_WRONG_TEAM)).otherwise(F.lit(_CONFLICT))
    code = F.when(F.col("static") == _UNKNOWN_TEAM, F.when(F.col("elsewhere"), F.lit(_WRONG_TEAM)).otherwise(F.lit(_UNKNOWN_TEAM))).otherwise(F.coalesce("static", late))
    verdict = own.join(decided, "move_id", "left").select("move_id", F.coalesce("accepted", F.lit(False)).alias("accepted"), code.alias("_code"))
    decisions = named.select("move_id", "kind").join(verdict, "move_id").select(
        "move_id", "kind", "accepted", F.when(~F.col("accepted"), F.get(reasons, F.col("_code"))).alias("reason")
    )
    decisions = decisions.unionByName(nameless.select("move_id", "kind", F.lit(False).alias("accepted"), F.lit(REASONS[_INVALID]).alias("reason")))

    out = players.join(teams_now.withColumn("_moved", F.lit(True)), "player_id", "left")
    after = F.when(F.col("_moved"), F.col("team_now")).otherwise(F.col("fantasy_team_id")).alias("fantasy_team_id")
    return out.select(*[after if c == "fantasy_team_id" else F.col(c) for c in players.columns]), decisions


def create_teams(teams: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append teams whose name and owner are non-empty; ids continue
    after the current maximum in request order. Returns (teams, rejected).

    Ids are a dense sequence in (move_ts, move_id) order (requests without a
    time last), numbered in two levels so no single task sees every request:
    row numbers within each request day, plus per-day offsets from a window
    over the day counts (one row per day)."""
    from pyspark.sql import Window

    ok = (F.length(F.trim(F.coalesce("team_name", F.lit("")))) > 0) & (
        F.length(F.trim(F.coalesce("owner_name", F.lit("")))) > 0
    )
    good = requests.where(ok).withColumn("_day", F.to_date("move_ts"))
    bad = requests.where(~ok)
    top = teams.agg(F.coalesce(F.max("team_id"), F.lit(0)).alias("m")).first()["m"]  # one scalar
    local = good.withColumn("_n", F.row_number().over(Window.partitionBy("_day").orderBy("move_ts", "move_id")))
    per_day = good.groupBy("_day").agg(F.count(F.lit(1)).alias("_c"))
    offsets = per_day.select(
        F.col("_day").alias("_d"),
        F.coalesce(
            F.sum("_c").over(Window.orderBy(F.asc_nulls_last("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    new = local.join(offsets, F.col("_day").eqNullSafe(F.col("_d")), "inner").select(
        (F.lit(top) + F.col("_off") + F.col("_n")).cast("bigint").alias("team_id"),
        F.trim("team_name").alias("team_name"),
        F.trim("owner_name").alias("owner_name"),
    )
    return teams.unionByName(new, allowMissingColumns=True), bad


def reset_rosters(players: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every player becomes a free agent and the team table is emptied
    (same end state as deleting teams one by one)."""
    return players.withColumn("fantasy_team_id", F.lit(None).cast("bigint")), teams.limit(0)
