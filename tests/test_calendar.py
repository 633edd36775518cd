"""Schedule operators: weekly rows, remaining games, past games."""

import datetime as dt

from pyspark.sql import functions as F

from rinkspark.operators import calendar as C


def games(spark, rows):
    df = spark.createDataFrame(rows, "game_id long, start string, home_abbrev string, away_abbrev string")
    return C.games_by_date(df.withColumn("start_time_utc", F.to_timestamp("start")))


def test_one_game_two_rows(spark):
    g = games(spark, [(1, "2025-11-12T00:00:00", "BOS", "TOR")])
    rows = {r.team: r for r in C.weekly_schedule(g).collect()}
    assert rows["BOS"].opponents == "vs TOR" and rows["TOR"].opponents == "@ BOS"
    assert rows["BOS"].game_count == 1 and rows["BOS"].week == "2025-W46"
    assert rows["BOS"].monday_date == dt.date(2025, 11, 10)


def test_opponents_in_time_order_and_count_law(spark):
    g = games(
        spark,
        [(3, "2025-11-15T18:00:00", "BOS", "MTL"), (1, "2025-11-11T23:00:00", "TOR", "BOS"), (2, "2025-11-13T23:00:00", "BOS", "DAL")],
    )
    w = C.weekly_schedule(g)
    bos = w.where("team = 'BOS'").first()
    assert bos.opponents == "@ TOR, vs DAL, vs MTL" and bos.game_count == 3
    assert w.agg(F.sum("game_count")).first()[0] == 2 * g.count()


def test_remaining_games_bounds_and_zero_fill(spark):
    # as_of Wednesday 2025-11-12 (local); Sunday 2025-11-16 in, Monday 2025-11-17 out
    g = games(
        spark,
        [
            (1, "2025-11-12T23:00:00", "BOS", "TOR"),
            (2, "2025-11-16T20:00:00", "TOR", "BOS"),
            (3, "2025-11-17T23:00:00", "BOS", "MTL"),
            (4, "2025-11-11T23:00:00", "BOS", "MTL"),
        ],
    )
    teams = spark.createDataFrame([("BOS",), ("TOR",), ("MTL",)], "team string")
    rows = {r.team: r for r in C.remaining_games(g, "2025-11-12", teams).collect()}
    assert rows["BOS"].games == ["vs TOR (2025-11-12)", "@ TOR (2025-11-16)"]
    assert rows["MTL"].n_games == 0 and rows["MTL"].games == []


def test_past_and_yesterday(spark):
    g = games(spark, [(1, "2025-11-12T23:00:00", "BOS", "TOR"), (2, "2025-11-11T23:00:00", "BOS", "TOR")])
    assert [r.game_id for r in C.past_games(g, "2025-11-12").collect()] == [2]
    assert [r.game_id for r in C.yesterday_games(g, "2025-11-12").collect()] == [2]
    c = C.past_future_counts(g, "2025-11-12").first()
    assert (c.n_past, c.n_future, c.n_undated) == (1, 1, 0)


def test_weekly_table_ids_and_reload(spark, tmp_dir):
    g = games(
        spark,
        [(1, "2025-11-12T00:00:00", "BOS", "TOR"), (2, "2025-11-20T00:00:00", "BOS", "MTL"), (3, "2025-11-21T00:00:00", "TOR", "MTL")],
    )
    t = C.weekly_schedule_table(g)
    rows = sorted((r.id, r.team, r.week) for r in t.collect())
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    assert [(r[1], r[2]) for r in rows] == sorted((r[1], r[2]) for r in rows)  # ids follow (team, week)
    assert C.reload_weekly_schedule(g, f"{tmp_dir}/ts") == 0  # rows cleared: a new table
    assert C.reload_weekly_schedule(g, f"{tmp_dir}/ts") == len(rows)
    assert C.reload_weekly_schedule(g.where("game_id = 1"), f"{tmp_dir}/ts") == len(rows)  # truncate and reload
