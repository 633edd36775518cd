"""Analysis operators on small hand-made facts."""

import datetime as dt

from pyspark.sql import functions as F

from rinkspark.operators import analysis as A
from rinkspark.sources.ingest import opponent

D = dt.date


def fact(spark, rows):
    return spark.createDataFrame(
        rows, "game_id long, player_id long, game_date date, season string, opponent_abbrev string, total_fpts double"
    )


def test_recent_form_window_bounds(spark):
    as_of = D(2025, 11, 30)
    f = fact(spark, [(1, 1, as_of - dt.timedelta(14), "S", "A", 2.0), (2, 1, as_of - dt.timedelta(15), "S", "A", 9.0)])
    r = A.recent_form(f, as_of).first()
    assert (r.games_last_14_days, r.avg_fpts_last_14_days) == (1, 2.0)


def _hot_inputs(spark):
    d = D(2025, 11, 20)
    rows = [(i, 1, d, "S", "X", 5.0) for i in range(2)] + [(10 + i, 2, d, "S", "X", 1.0) for i in range(3)]
    rows += [(20 + i, 3, d, "S", "X", 3.0) for i in range(3)] + [(30, 3, D(2025, 1, 1), "S", "X", 99.0)]
    players = spark.createDataFrame(
        [(1, "One", "BOS", "C", None), (2, "Two", "TOR", "D", 7), (3, "Three", "MTL", "L", None)],
        "player_id long, player_name string, team_abbrev string, position string, fantasy_team_id long",
    )
    teams = spark.createDataFrame([(7, "Sharks", "ann")], "team_id long, team_name string, owner_name string")
    return fact(spark, rows), players, teams


def test_hot_list_having_order_and_label(spark):
    f, players, teams = _hot_inputs(spark)
    out = A.hot_list(f, players, teams, D(2025, 11, 30)).collect()
    assert [r.player_id for r in out] == [3, 2]  # player 1 has only 2 games
    assert [r.fantasy_team for r in out] == ["*** Free Agent ***", "Sharks"]
    assert out[0].avg_fpts_last_14 == 3.0  # the old 99-point game is outside the window


def test_hot_list_free_agents_only_and_limit(spark):
    f, players, teams = _hot_inputs(spark)
    assert [r.player_id for r in A.hot_list(f, players, teams, D(2025, 11, 30), free_agents_only=True).collect()] == [3]
    assert A.hot_list(f, players, teams, D(2025, 11, 30), limit=1).count() == 1


def test_opponent_rule(spark):
    df = spark.createDataFrame(
        [("BOS", "BOS", "TOR"), ("TOR", "BOS", "TOR"), ("MTL", "BOS", "TOR")],
        "team_abbrev string, home_abbrev string, away_abbrev string",
    )
    assert [r[0] for r in df.select(opponent()).collect()] == ["TOR", "BOS", "BOS"]


def test_ranked_difficulty_per_season(spark):
    rows = [(i, 1, D(2025, 1, 1), "S1", f"T{i}", float(i)) for i in range(25)]
    out = A.ranked_difficulty(fact(spark, rows), by=["season"]).orderBy("rank").collect()
    assert out[0].opponent_abbrev == "T24" and out[0].difficulty == "Easy"
    assert out[-1].rank == 25 and out[-1].difficulty == "Hard"


def test_matchup_outlook_missing_opponent_once(spark):
    players = spark.createDataFrame([(1, "BOS", False)], "player_id long, team_abbrev string, is_goalie boolean")
    sched = spark.createDataFrame([("BOS", "2025-W47", 2, "vs TOR, @ MTL")], "team string, week string, game_count int, opponents string")
    diff = spark.createDataFrame([(False, "TOR", 3.0, 4)], "is_goalie boolean, opponent_abbrev string, avg_fpts_allowed double, rank int")
    out = A.matchup_outlook(players, sched, diff, "2025-W47").orderBy("slot").collect()
    assert [(r.opponent_abbrev, r.difficulty) for r in out] == [("TOR", "Easy"), ("MTL", "No difficulty data")]


def test_player_report_branches_and_empty_parts(spark):
    f = spark.createDataFrame(
        [(1, 1, D(2025, 11, 1), "S", "TOR", 2.0, 1, 1, 3, 1, 2, 600)],
        "game_id long, player_id long, game_date date, season string, opponent_abbrev string, total_fpts double, "
        "goals int, assists int, shots int, hits int, blocked_shots int, toi_seconds int",
    )
    players = spark.createDataFrame([(1, "One"), (2, "Two")], "player_id long, player_name string")
    base = A.skater_baseline(f, players, "S")
    rep = A.player_report(players, base, A.recent_form(f, D(2025, 11, 30)), A.history_vs_opponent(f))
    rows = {r.player_id: r for r in rep.collect()}
    assert rows[1].games_played == 1 and rows[1].history[0].opponent_abbrev == "TOR"
    assert rows[1].avg_toi_min == 10.0
    assert rows[2].games_played is None and rows[2].history is None and rows[2].games_last_14_days is None


def test_search_is_case_insensitive_and_literal(spark):
    players = spark.createDataFrame([(1, "Sébastien Aho"), (2, "A_b"), (3, "Axb")], "player_id long, player_name string")
    assert [r.player_id for r in A.search_players(players, "SÉB").collect()] == [1]
    assert [r.player_id for r in A.search_players(players, "a_b").collect()] == [2]
    assert sorted(r.player_id for r in A.search_players(players, "a_b", wildcards=True).collect()) == [2, 3]


def test_search_many(spark):
    players = spark.createDataFrame([(1, "Red Bolt"), (2, "blue bolt")], "player_id long, player_name string")
    terms = spark.createDataFrame([("bolt",), ("red",)], "term string")
    got = sorted((r.term, r.player_id) for r in A.search_many(players, terms).collect())
    assert got == [("bolt", 1), ("bolt", 2), ("red", 1)]


def test_lookups(spark):
    players = spark.createDataFrame(
        [(1, "Zed", 5), (2, "Amy", 5), (3, "Bob", None)], "player_id long, player_name string, fantasy_team_id long"
    )
    assert [r.player_id for r in A.free_agents(players).collect()] == [3]
    assert [r.player_name for r in A.roster_of(players, 5).collect()] == ["Amy", "Zed"]
    assert A.player_by_id(players, 2).first().player_name == "Amy"
    f = fact(spark, [(1, 1, D(2025, 1, 1), "S", "A", 1.0), (2, 1, D(2025, 1, 3), "S", "A", 2.0)])
    assert [r.game_id for r in A.game_log(f, 1).collect()] == [2, 1]
    both = A.stats_on_date(f, f.withColumn("saves", F.lit(3)), D(2025, 1, 3))
    assert sorted(r.kind for r in both.collect()) == ["goalie", "skater"]


def test_search_many_gram_path_equals_broadcast_path(spark):
    names = ["Red Bolt", "blue bolt", "Sébastien Aho", "ab", "x", "Bolton Red"]
    players = spark.createDataFrame(list(enumerate(names)), "player_id long, player_name string")
    terms = spark.createDataFrame([(t,) for t in ["bolt", "RED", "a", "ab", "séb", "zzz", "o", "bolton red", "ed"]], "term string")
    small = sorted((r.term, r.player_id) for r in A.search_many(players, terms).collect())
    exact = sorted((r.term, r.player_id) for r in A.search_many(players, terms, max_broadcast_terms=0).collect())
    assert small == exact
    assert ("bolton red", 5) in exact and ("a", 2) in exact


def test_gram_search_never_broadcasts_the_pieces_of_the_names(spark):
    # Spark takes an explode to be as small as its input, so with fewer names than terms it picked the names' pieces.
    players = spark.createDataFrame([(1, "Red Bolt"), (2, "blue bolt")], "player_id long, player_name string")
    terms = spark.createDataFrame([(f"t{i}",) for i in range(300)] + [("bolt",), ("ed",)], "term string")
    found = A.search_many(players, terms, max_broadcast_terms=0)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert sorted((r.term, r.player_id) for r in found.collect()) == [("bolt", 1), ("bolt", 2), ("ed", 1)]


def test_team_week(spark):
    sched = spark.createDataFrame(
        [("BOS", "2025-W46", 2, "@ DAL, vs WPG"), ("BOS", "2025-W47", 1, "vs TOR"), ("TOR", "2025-W46", 1, "@ BOS")],
        "team string, week string, game_count int, opponents string",
    )
    rows = A.team_week(sched, "BOS", "2025-W46").collect()
    assert [(r.game_count, r.opponents) for r in rows] == [(2, "@ DAL, vs WPG")]
