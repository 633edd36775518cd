"""Readers of landed files (S1-S4) and the landed-game register.

Fetching from the web API is not part of the library; a landing job drops
raw JSON (one document per line) and these readers parse it with declared
schemas. Rows that do not parse go to ``_corrupt_record`` and can be split
off as a quarantine table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark import constants as K
from rinkspark import schemas
from rinkspark.functions.calendar import parse_instant
from rinkspark.sources.store import latest_per_key

CORRUPT = "_corrupt_record"

# Game states the schedule reports for a game that is over.
FINAL_STATES = ("OFF", "FINAL")


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Permissive JSON read with a declared schema; bad lines keep their
    text in ``_corrupt_record`` (use :func:`split_corrupt`). ``landed_at`` is
    the document's own landing time, else the file's modification time."""
    df = (
        spark.read.schema(_with_corrupt(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return with_landing_time(df)


def with_landing_time(df: DataFrame) -> DataFrame:
    """``landed_at`` as a timestamp on a file scan (batch or stream)."""
    if "landed_at" not in df.columns:
        return df
    return df.withColumn("landed_at", F.coalesce(F.try_to_timestamp("landed_at"), F.col("_metadata.file_modification_time")))


def latest_landing(docs: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The last landed document per key (of equal landing times the greatest
    as JSON text); one aggregation. The documents, which were read from JSON,
    move as that text. ``partitions``: into how many the keys are dealt."""
    text = F.to_json(F.struct(*[F.col(c) for c in docs.columns])).alias("text")
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.struct("landed_at", text).alias("_last"))
    if partitions is not None:
        rows = rows.repartition(partitions, "_key")
    body = T.StructType([f for f in docs.schema.fields if f.name not in (key, "landed_at")])
    last = rows.groupBy("_key").agg(F.max("_last").alias("_last"))
    last = last.select("_key", F.col("_last.landed_at").alias("_at"), F.from_json("_last.text", body).alias("_doc"))
    # The group's key, not the document's: it tells Spark how the rows are dealt.
    own = {key: F.col("_key"), "landed_at": F.col("_at")}
    return last.select(*[own.get(c, F.col(f"_doc.{c}")).alias(c) for c in docs.columns])


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, quarantined rows with their raw
    text). The quarantine keeps the parsed columns too: Spark refuses a scan
    of raw JSON that reads the corrupt-record column alone."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull())
    return good, bad


def write_quarantine(df: DataFrame, path: str) -> None:
    """Write the rows that did not parse (raw text and whatever parsed) to a
    quarantine folder, replacing what an earlier run of the same batch wrote;
    count or inspect them from that table."""
    _, bad = split_corrupt(df)
    bad.write.mode("overwrite").parquet(path)


# ------------------------------------------------------------------- S1
def schedule_games(schedule_docs: DataFrame) -> DataFrame:
    """S1 + T2: one row per game of the landed team schedules, flattened.

    ``schedule_docs`` holds ``games`` arrays (one document per team file,
    optionally with ``landed_at``)."""
    cols = [F.explode("games").alias("g")]
    if "landed_at" in schedule_docs.columns:
        cols.append("landed_at")
    g = schedule_docs.select(*cols)
    out = g.select(
        F.col("g.id").alias("game_id"),
        F.col("g.season").alias("season"),
        F.col("g.gameType").alias("game_type"),
        parse_instant(F.col("g.startTimeUTC")).alias("start_time_utc"),
        F.col("g.gameState").alias("game_state"),
        F.col("g.homeTeam.abbrev").alias("home_abbrev"),
        F.col("g.homeTeam.commonName.default").alias("home_name"),
        F.col("g.awayTeam.abbrev").alias("away_abbrev"),
        F.col("g.awayTeam.commonName.default").alias("away_name"),
        *(["landed_at"] if "landed_at" in schedule_docs.columns else []),
    )
    return out


def read_schedules(spark: SparkSession, path: str) -> DataFrame:
    docs, _ = split_corrupt(read_json(spark, path, schemas.SCHEDULE))
    return schedule_games(docs)


def regular_season(games: DataFrame, game_type: int = K.REGULAR_SEASON_GAME_TYPE) -> DataFrame:
    """Keep one game type (regular season by default)."""
    return games.where(F.col("game_type") == game_type)


def unique_games(games: DataFrame, *, version_col: str | None = "landed_at") -> DataFrame:
    """One row per game across the team files. Both teams' files carry
    the same game; with a version column the latest landing wins (max of a
    struct, combined map-side), else any copy (they are equal)."""
    if version_col is None or version_col not in games.columns:
        return games.dropDuplicates(["game_id"])
    rest = [c for c in games.columns if c not in ("game_id", version_col)]
    best = F.max(F.struct(F.col(version_col), *[F.col(c) for c in rest])).alias("_b")
    return games.groupBy("game_id").agg(best).select(
        "game_id", *[F.col(f"_b.{c}").alias(c) for c in rest], F.col(f"_b.{version_col}").alias(version_col)
    )


# ------------------------------------------------------------------- S2
def read_boxscores(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """The last landed box score of each game, dealt by game (into
    ``partitions`` if given)."""
    docs, _ = split_corrupt(read_json(spark, path, schemas.BOXSCORE))
    return latest_landing(docs, "id", partitions)


def box_headers(box: DataFrame) -> DataFrame:
    """Game header of each box score (T8's required join side)."""
    return box.select(
        F.col("id").alias("game_id"),
        F.col("gameDate").alias("box_game_date"),
        F.col("homeTeam.abbrev").alias("home_abbrev"),
        F.col("awayTeam.abbrev").alias("away_abbrev"),
    )


_LINE_FIELDS = (
    ("player_id", "bigint"),
    ("box_name", "string"),
    ("box_position", "string"),
    ("goals", "int"),
    ("assists", "int"),
    ("shots", "int"),
    ("blocked_shots", "int"),
    ("hits", "int"),
    ("jersey_number", "int"),
    ("saves", "int"),
    ("save_pct", "double"),
    ("goals_against", "int"),
    ("decision", "string"),
)


def _lift(arr, side: str, group: str, goalie: bool):
    """Project one player array to the common line struct."""

    def one(x):
        def g(name, typ):
            return x[name].cast(typ)

        nul = {t: F.lit(None).cast(t) for _, t in _LINE_FIELDS}
        vals = {
            "player_id": g("playerId", "bigint"),
            "box_name": x["name"]["default"],
            "box_position": x["position"],
            "jersey_number": g("sweaterNumber", "int"),
        }
        if goalie:
            vals.update(
                saves=g("saves", "int"),
                save_pct=g("savePctg", "double"),
                goals_against=g("goalsAgainst", "int"),
                decision=x["decision"],
            )
        else:
            vals.update(
                goals=g("goals", "int"),
                assists=g("assists", "int"),
                shots=g("sog", "int"),
                blocked_shots=g("blockedShots", "int"),
                hits=g("hits", "int"),
            )
        fields = [vals.get(n, nul[t]).alias(n) for n, t in _LINE_FIELDS]
        return F.struct(F.lit(side).alias("side"), F.lit(group).alias("group"), *fields)

    return F.coalesce(F.transform(arr, one), F.array())


def box_lines(box: DataFrame) -> DataFrame:
    """T4: the six player arrays (away/home x forwards/defense/goalies, in
    that order) lifted to one struct type and exploded: one row per player
    line, with the slot it came from."""
    arrays = []
    for side in ("awayTeam", "homeTeam"):
        for group in ("forwards", "defense", "goalies"):
            arr = F.col(f"playerByGameStats.{side}.{group}")
            arrays.append(_lift(arr, "away" if side == "awayTeam" else "home", group, group == "goalies"))
    lines = box.select(F.col("id").alias("game_id"), F.posexplode(F.concat(*arrays)).alias("slot", "l"))
    return lines.select("game_id", "slot", "l.*")


def batch_players(lines: DataFrame) -> DataFrame:
    """T5: distinct player ids of a batch."""
    return lines.select("player_id").distinct()


# ------------------------------------------------------------------- S3
def read_player_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log entries, the last landed one per (player, game)."""
    docs, _ = split_corrupt(read_json(spark, path, schemas.PLAYER_LOG))
    return latest_per_key(log_entries(docs), ["player_id", "game_id"], ["landed_at"]).drop("landed_at")


def log_entries(logs: DataFrame) -> DataFrame:
    """S3: one row per (player, game) of the landed player logs."""
    landed = ["landed_at"] if "landed_at" in logs.columns else []
    e = logs.select("player_id", F.explode("gameLog").alias("e"), *landed)
    return e.select(
        "player_id",
        F.col("e.gameId").alias("game_id"),
        F.col("e.teamAbbrev").alias("team_abbrev"),
        F.col("e.gameDate").alias("log_game_date"),
        F.col("e.powerPlayPoints").alias("pp_points"),
        F.col("e.shorthandedPoints").alias("sh_points"),
        F.col("e.toi").alias("toi"),
        F.col("e.shifts").alias("shifts"),
        F.col("e.pim").alias("pim"),
        *landed,
    )


# ------------------------------------------------------------------- S4
def read_weekly_csv(spark: SparkSession, path: str) -> DataFrame:
    """The weekly schedule CSV, renamed and typed to ``team_schedule``."""
    raw = spark.read.schema(schemas.WEEKLY_CSV).option("header", True).csv(path)
    return raw.select(
        F.col("Team").alias("team"),
        F.col("Week").alias("week"),
        F.try_to_date("Monday_Date").alias("monday_date"),
        F.try_to_date("Sunday_Date").alias("sunday_date"),
        F.col("Game_Count").alias("game_count"),
        F.col("Opponents").alias("opponents"),
    )


# ------------------------------------------------------------------ S10
def register_entries(games: DataFrame, landed_at=None) -> DataFrame:
    """Landed-game register rows from the schedule: status ``final`` only
    when the schedule says the game is over (not every fetched game)."""
    ts = F.current_timestamp() if landed_at is None else F.lit(landed_at).cast("timestamp")
    status = F.when(F.col("game_state").isin(*FINAL_STATES), F.lit("final")).otherwise(F.lit("pending"))
    return games.select("game_id", status.alias("status"), ts.alias("cached_at"))


def register_payload(box: DataFrame, log: DataFrame) -> DataFrame:
    """S10 with payload: rows (game_id, landed_at, payload) of box scores, one
    per game, with the raw box score and the game's log lines as one VARIANT
    (``$.box``, ``$.lines``). A game's lines are a roster's worth. Box scores
    and a log that are dealt by game likewise are not shuffled again."""
    body = [c for c in box.columns if c not in ("landed_at", CORRUPT)]
    lines = log.groupBy(F.col("game_id").alias("id")).agg(F.collect_list(F.struct(*[F.col(c) for c in log.columns if c != "game_id"])).alias("lines"))
    landed = F.col("landed_at") if "landed_at" in box.columns else F.lit(None).cast("timestamp")
    rows = box.select("id", landed.alias("landed_at"), F.struct(*body).alias("box")).join(lines.hint("merge"), "id", "left")
    return rows.select(F.col("id").alias("game_id"), "landed_at", F.parse_json(F.to_json(F.struct("box", "lines"))).alias("payload"))


def replay_payload(register: DataFrame, log_schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Box scores and log lines from the register alone: what
    :func:`register_payload` was given (``log_schema``: its log columns), of
    the last landing per game. A register that is bucketed by game
    (``store.bucketed``) is not shuffled."""
    doc = T.StructType([f for f in schemas.BOXSCORE.fields if f.name != "landed_at"])
    line = T.StructType([f for f in log_schema.fields if f.name != "game_id"])
    # One shuffle of the payloads; as a struct a null landing time is the oldest.
    last = F.max_by(F.struct("landed_at", "payload"), F.struct("landed_at")).alias("_last")
    kept = register.where(F.col("game_id").isNotNull()).groupBy("game_id").agg(last).select("game_id", "_last.*")
    kept = kept.hint("merge")  # the files' bytes, by which Spark would broadcast them, are packed
    part = lambda path, kind: F.from_json(F.to_json(F.variant_get("payload", path, "variant")), kind)
    # The game is the box score's id; the group's key tells Spark how the rows are dealt.
    own = {"id": F.col("game_id")}
    box = kept.select("game_id", part("$.box", doc).alias("b"), "landed_at").select(
        *[own.get(c, F.col(f"b.{c}")).alias(c) for c in doc.names], "landed_at"
    )
    lines = kept.select("game_id", F.explode(part("$.lines", T.ArrayType(line))).alias("l")).select("game_id", "l.*")
    return box, lines.select(*log_schema.names)


def games_to_process(requested: DataFrame, register: DataFrame) -> DataFrame:
    """Requested games that are not yet landed as final (anti-join)."""
    final = register.where(F.col("status") == "final").select("game_id")
    return requested.join(final, "game_id", "left_anti")


def restrict_to_batch(log: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """Keep log lines of the batch's games and players (two semi-joins;
    Spark adds a runtime bloom filter when the build sides are small)."""
    return log.join(games.select("game_id"), "game_id", "left_semi").join(
        players.select("player_id"), "player_id", "left_semi"
    )
