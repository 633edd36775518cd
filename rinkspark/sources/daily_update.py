"""The daily update as one Spark job (the source tool's daily lifecycle).

    landed schedule --T1/T3/C1--> games --C3--> yesterday's games
        --S10 anti-join with the register (final games)--> games to process
    landed box scores + player logs --T6 semi-joins--> this batch
        --T7..T12--> skater and goalie lines
        --S8 upsert--> next fact snapshots
        --A1..A5 for the touched players, S9--> next dimension snapshot
    register --S8 upsert with the schedule's state--> next register snapshot

Landings: schedules, box scores and logs may be landed again; the last
landing of each game, and of each (player, game) log entry, is used. Lines
that do not parse are written to ``_quarantine`` of the store.

The facts are partitioned by (season, game_date) and merged in atomic commits
(``manifest.PartitionedTable``): a key index finds the old rows of a batch
wherever they are (a corrected date moves a row to another partition), and only
the partitions concerned are read and written. Every fact row keeps the landing
time of its box score, so an older landing that is processed later replaces
nothing, in a batch run as in the stream. The dimension and the register are
snapshot folders with append-only pointers (``store.write_snapshot``).
A re-run of the same day gives the same tables (games already final are
skipped; others are merged again, replacing their own rows).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark import schemas
from rinkspark.constants import GOALIE_POSITION
from rinkspark.functions.calendar import league_date
from rinkspark.operators.calendar import past_games, yesterday_games
from rinkspark.operators.dimension import prior_season_averages, rebuild_dimension
from rinkspark.operators.joins import has_at_most
from rinkspark.sources import landed as L
from rinkspark.sources.ingest import enriched_lines, goalie_fact, skater_fact
from rinkspark.sources.manifest import PartitionedTable
from rinkspark.sources.store import (
    conform,
    current_snapshot,
    empty_table,
    upsert,
    write_snapshot,
)

FACT_KEY = ["game_id", "player_id"]
FACT_PARTITIONS = ["season", "game_date"]
FACT_SCHEMAS = {"player_game_stats": schemas.PLAYER_GAME_STATS, "goalie_game_stats": schemas.GOALIE_GAME_STATS}
REGISTER = "register"
# Touched players up to this many are passed to the scan as a literal list.
MAX_LITERAL_IDS = 10_000


@dataclass(frozen=True)
class Paths:
    schedule: str
    boxscores: str
    logs: str
    store: str


def _current(spark: SparkSession, root: str, empty: DataFrame) -> DataFrame:
    path = current_snapshot(spark, root)
    return spark.read.parquet(path) if path else empty


def fact_table(spark: SparkSession, store: str, name: str) -> PartitionedTable:
    return PartitionedTable(
        spark,
        f"{store}/{name}",
        FACT_SCHEMAS[name],
        key=FACT_KEY,
        partition_by=FACT_PARTITIONS,
        index_on="game_id",
        sort_by=["player_id", "game_id"],
        version="landed_at",
    )


def read_fact(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """A fact table of the store with its declared schema (None if absent)."""
    table = fact_table(spark, store, name)
    return table.read() if table.exists() else None


def _stage(df: DataFrame, store: str, name: str, by: str | None = None) -> DataFrame:
    """Write rows once below the store, partitioned by a column if one is
    named, and read them back: they are used several times, and a path cannot
    be overwritten while a job reads it."""
    path = f"{store}/_staging/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merge_into_partitions(spark: SparkSession, fresh: DataFrame, store: str, name: str) -> None:
    """S8 on a partitioned fact: ``fresh`` replaces the rows of its keys in
    whatever (season, game_date) partition they are, in one commit."""
    fact_table(spark, store, name).merge(fresh)


def _empty_register(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "game_id bigint, status string, cached_at timestamp")


def schedule_games(spark: SparkSession, schedule_path: str) -> DataFrame:
    """Regular-season games of the landed schedules, one row per game, with
    their league-zone date."""
    games = L.regular_season(L.unique_games(L.read_schedules(spark, schedule_path)))
    return games.withColumn("game_date", league_date("start_time_utc"))


def apply_box_scores(
    spark: SparkSession,
    box: DataFrame,
    logs: DataFrame,
    games: DataFrame,
    store: str,
    *,
    season=None,
    landed_at=None,
) -> dict[str, str]:
    """Land the games of ``box`` (box-score documents): their log lines are
    merged into facts (S8 upsert), the touched players' dimension rows are
    refreshed (A6/A7, S9) and the games enter the register with the
    schedule's state (S10). Shared by the daily job and the stream. The season
    totals cover ``season``, else the latest season of the batch's games."""
    box = _stage(box, store, "box-scores")  # the landed files are read once
    batch_ids = box.select(F.col("id").alias("game_id")).where(F.col("game_id").isNotNull()).distinct()
    log = L.restrict_to_batch(logs, batch_ids, L.batch_players(L.box_lines(box)))
    seasons = games.select("game_id", F.col("season").cast("string").alias("season"))
    if season is None:
        season = seasons.join(batch_ids, "game_id", "left_semi").agg(F.max("season")).first()[0]
    # Enriched once, and each fact reads the lines of its kind.
    kind = F.when(F.col("raw_position") == GOALIE_POSITION, F.lit("goalie")).otherwise(F.lit("skater"))
    lines = _stage(enriched_lines(spark, log, box, seasons=seasons).withColumn("kind", kind), store, "lines", by="kind")
    skaters, goalies = skater_fact(lines.where(F.col("kind") == "skater")), goalie_fact(lines.where(F.col("kind") == "goalie"))
    if "landed_at" in box.columns:
        landed = box.select(F.col("id").alias("game_id"), "landed_at")  # one row per game
        skaters, goalies = skaters.join(landed, "game_id", "left"), goalies.join(landed, "game_id", "left")
    # Used by the merge, the touched players and the dimension.
    skaters, goalies = _stage(skaters, store, "skater-batch"), _stage(goalies, store, "goalie-batch")

    out: dict[str, str] = {}
    for name, fresh in (("player_game_stats", skaters), ("goalie_game_stats", goalies)):
        merge_into_partitions(spark, fresh, store, name)
        out[name] = f"{store}/{name}"

    # A6/A7 for the players this batch touched: their rows of the season
    # (partition-pruned when a season is given), from the updated facts.
    touched = skaters.select("player_id").unionByName(goalies.select("player_id")).distinct()
    # A day touches few players: when their number is proven small, a
    # literal IN filter reaches the Parquet scan, and files sorted by player
    # let min/max statistics skip most row groups. Otherwise a semi-join.
    ids = None
    if has_at_most(touched, MAX_LITERAL_IDS):
        ids = [r.player_id for r in touched.collect()]  # bounded by the check

    def history(name):
        f = read_fact(spark, store, name)
        if f is None:
            return empty_table(spark, name)
        if season is not None:
            f = f.where(F.col("season") == F.lit(season))
        if ids is not None:
            return f.where(F.col("player_id").isin(ids))
        return f.join(touched, "player_id", "left_semi")

    sk_all, gk_all = history("player_game_stats"), history("goalie_game_stats")
    dim_root = f"{store}/pro_players"
    dim = _current(spark, dim_root, empty_table(spark, "pro_players"))
    new_dim = conform(rebuild_dimension(dim, sk_all, gk_all, season), schemas.PRO_PLAYERS)
    new_dim = new_dim.withColumns({"is_active": F.coalesce("is_active", F.lit(True)), "player_name": F.coalesce("player_name", F.lit("Unknown"))})
    out["pro_players"] = write_snapshot(new_dim, dim_root)

    reg_root = f"{store}/{REGISTER}"
    register = _current(spark, reg_root, _empty_register(spark))
    entries = L.register_entries(games.join(batch_ids, "game_id", "left_semi"), landed_at)
    out[REGISTER] = write_snapshot(upsert(register, entries, "game_id"), reg_root)
    return out


def _run_batch(spark: SparkSession, paths: Paths, as_of, pick, season, landed_at) -> dict[str, str]:
    """Process the games that ``pick(games)`` names and that are not landed as
    final yet."""
    for name, path, schema in (("schedule", paths.schedule, schemas.SCHEDULE), ("boxscores", paths.boxscores, schemas.BOXSCORE), ("logs", paths.logs, schemas.PLAYER_LOG)):
        L.write_quarantine(L.read_json(spark, path, schema), f"{paths.store}/_quarantine/{name}/as_of={as_of}")
    games = schedule_games(spark, paths.schedule)
    register = _current(spark, f"{paths.store}/{REGISTER}", _empty_register(spark))
    todo = L.games_to_process(pick(games).select("game_id"), register)
    box = L.read_boxscores(spark, paths.boxscores).join(todo.select(F.col("game_id").alias("id")), "id", "left_semi")
    logs = L.read_player_logs(spark, paths.logs)
    return apply_box_scores(spark, box, logs, games, paths.store, season=season, landed_at=landed_at)


def run_daily_update(spark: SparkSession, paths: Paths, as_of, *, season=None, landed_at=None) -> dict[str, str]:
    """Process yesterday's games (relative to ``as_of``) that are not yet
    landed as final; season totals in the dimension cover ``season`` (the
    latest season of the batch when None). Returns the new snapshot path of
    each table. Lines that do not parse go to ``_quarantine/<source>``."""
    return _run_batch(spark, paths, as_of, lambda games: yesterday_games(games, as_of), season, landed_at)


def run_season_seed(spark: SparkSession, paths: Paths, as_of, *, season=None, landed_at=None) -> dict[str, str]:
    """Rebuild from the landed files: all games before ``as_of`` (C2) that are
    not yet landed as final, of ``season`` if it is given. The tables are the
    same as after the daily runs of those days."""

    def past(games: DataFrame) -> DataFrame:
        g = past_games(games, as_of)
        return g if season is None else g.where(F.col("season").cast("string") == F.lit(str(season)))

    return _run_batch(spark, paths, as_of, past, season, landed_at)


def run_prior_season(spark: SparkSession, store: str, prior_season) -> str:
    """Write the prior season's games and mean points of the players in the
    dimension (A8) as its next snapshot; returns the snapshot's path."""
    dim_root = f"{store}/pro_players"
    dim = _current(spark, dim_root, empty_table(spark, "pro_players"))
    facts = []
    for name in FACT_SCHEMAS:
        f = read_fact(spark, store, name)
        facts.append(empty_table(spark, name) if f is None else f)
    return write_snapshot(conform(prior_season_averages(dim, *facts, prior_season), schemas.PRO_PLAYERS), dim_root)


def stream_box_scores(
    spark: SparkSession,
    paths: Paths,
    *,
    season=None,
    max_files_per_trigger: int = 100,
    checkpoint: str | None = None,
) -> None:
    """X1-X3 over the landed formats: every new box-score file in the
    landing folder is a micro-batch that runs :func:`apply_box_scores`
    (``availableNow``: everything landed so far, then stop). The schedule and
    the player logs are read as they are when each batch runs. Lines that do
    not parse go to ``_quarantine/boxscores/batch=<n>`` of the store."""
    ckpt = checkpoint or f"{paths.store}/_stream_checkpoint"
    stream = (
        spark.readStream.schema(L._with_corrupt(schemas.BOXSCORE))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", L.CORRUPT)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(paths.boxscores)
    )
    stream = L.with_landing_time(stream)

    def per_batch(box: DataFrame, batch_id: int) -> None:
        s = box.sparkSession
        # Written once: the batch is used for the quarantine and the facts.
        box = _stage(box, paths.store, f"box-batch-{batch_id}")
        L.write_quarantine(box, f"{paths.store}/_quarantine/boxscores/batch={batch_id}")
        box, _ = L.split_corrupt(box)
        games = schedule_games(s, paths.schedule)
        logs = L.read_player_logs(s, paths.logs)
        apply_box_scores(s, L.latest_landing(box, "id"), logs, games, paths.store, season=season)

    q = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
