"""Player dimension: latest info, precedence, totals, increments, rosters."""

import datetime as dt

from pyspark.sql import functions as F

from rinkspark.operators import dimension as D

SK = "game_id long, player_id long, game_date date, season string, player_name string, team_abbrev string, position string, jersey_number int, goals int, total_fpts double"
GK = "game_id long, player_id long, game_date date, season string, player_name string, team_abbrev string, wins int, saves int, total_fpts double"


def test_latest_info_tie_takes_higher_game_id(spark):
    d = dt.date(2025, 11, 1)
    f = spark.createDataFrame(
        [(10, 1, d, "S", "Old", "BOS", "C", 9, 1, 2.0), (11, 1, d, "S", "New", "TOR", "C", 9, 0, 0.0)], SK
    )
    r = D.latest_info(f).first()
    assert (r.player_name, r.team_abbrev, r.latest_game_id) == ("New", "TOR", 11)


def test_goalie_precedence(spark):
    g = spark.createDataFrame([(1, "G")], "player_id long, who string")
    s = spark.createDataFrame([(1, "S"), (2, "S")], "player_id long, who string")
    got = sorted((r.player_id, r.who) for r in D.union_with_precedence(g, s).collect())
    assert got == [(1, "G"), (2, "S")]


def _facts(spark):
    d = dt.date(2025, 11, 1)
    sk = spark.createDataFrame(
        [(1, 1, d, "S", "A", "BOS", "C", 9, 1, 2.5), (2, 1, d + dt.timedelta(1), "S", "A", "BOS", "C", 9, 2, 4.0),
         (3, 2, d, "S", "B", "TOR", "D", 4, 0, 1.0), (4, 2, d, "OLD", "B", "TOR", "D", 4, 5, 9.0)],
        SK,
    )
    gk = spark.createDataFrame([(5, 3, d, "S", "G", "MTL", 1, 30, 13.0)], GK)
    return sk, gk


def test_incremental_equals_full_and_is_idempotent(spark):
    sk, _ = _facts(spark)
    full = D.skater_season_totals(sk, "S")
    before = D.skater_season_totals(sk.where("game_id = 1"), "S")
    batch = sk.where("game_id in (2, 3)")
    once = D.incremental_totals(before, sk, batch, season="S")
    twice = D.incremental_totals(once, sk, batch, season="S")
    key = lambda df: sorted(tuple(r) for r in df.select(*full.columns).collect())
    assert key(once) == key(full) == key(twice)


def test_rebuild_keeps_other_players_and_roster(spark):
    sk, gk = _facts(spark)
    dim = spark.createDataFrame(
        [(1, "A", "BOS", "C", False, 7, None), (9, "Nobody", "SEA", "C", False, 3, 12)],
        "player_id long, player_name string, team_abbrev string, position string, is_goalie boolean, fantasy_team_id long, season_games_played int",
    )
    out = {r.player_id: r for r in D.rebuild_dimension(dim, sk, gk, "S").collect()}
    assert out[9].season_games_played == 12 and out[9].fantasy_team_id == 3  # untouched
    assert out[1].season_games_played == 2 and out[1].fantasy_team_id == 7  # roster kept
    assert out[3].position == "Goalie" and out[3].is_goalie and out[3].season_wins == 1  # new goalie added
    assert out[2].season_goals == 0  # the OLD season game does not count


def test_prior_season_update_only(spark):
    sk, gk = _facts(spark)
    dim = spark.createDataFrame([(1, None, None), (3, None, None)], "player_id long, prior_season_games_played int, prior_season_avg_fpts double")
    out = {r.player_id: r for r in D.prior_season_averages(dim, sk, gk, "S").collect()}
    assert set(out) == {1, 3}
    assert (out[1].prior_season_games_played, out[1].prior_season_avg_fpts) == (2, 3.25)
    assert out[3].prior_season_avg_fpts == 13.0


def test_roster_counts_keep_empty_team(spark):
    teams = spark.createDataFrame([(1, "B", "x"), (2, "A", "y")], "team_id long, team_name string, owner_name string")
    players = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "player_id long, fantasy_team_id long")
    out = [(r.team_name, r.n_players) for r in D.roster_counts(teams, players).collect()]
    assert out == [("A", 0), ("B", 2)]
    assert D.roster_count(players, 1).first().n_players == 2


def test_delta_totals_equal_recompute_and_are_idempotent(spark):
    sk, _ = _facts(spark)
    season = sk.where("season = 'S'")
    stored = season.where("game_id in (1, 3)")
    totals0 = D.skater_season_totals(stored)
    # batch: a correction of game 1 (goals 1 -> 3) and a new game 2
    fresh = season.where("game_id in (1, 2)").withColumn(
        "goals", F.when(F.col("game_id") == 1, F.lit(3)).otherwise(F.col("goals"))
    )
    replaced = stored.where("game_id = 1")  # the stored row the batch overwrites
    once = D.delta_totals(totals0, fresh, replaced)
    after = stored.where("game_id = 3").unionByName(fresh)  # the fact after the merge
    full = D.skater_season_totals(after)
    key = lambda df: sorted(tuple(r) for r in df.select(*full.columns).collect())
    assert key(once) == key(full)
    # re-applying the same batch: it now replaces exactly its own rows
    assert key(D.delta_totals(once, fresh, fresh)) == key(full)
