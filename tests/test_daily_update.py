"""The daily job end to end on landed JSON: facts, dimension, register,
and a re-run of the same day that changes nothing."""

from rinkspark.operators import dimension as D
from rinkspark.sources.daily_update import Paths, read_fact, run_daily_update
from rinkspark.sources.store import read_current
from test_ingest import box_doc, game, write_lines


def _box(gid, home, away, away_g_decision="W"):
    doc = box_doc()
    doc["id"] = gid
    doc["homeTeam"] = {"abbrev": home}
    doc["awayTeam"] = {"abbrev": away}
    doc["playerByGameStats"]["awayTeam"]["goalies"][0]["decision"] = away_g_decision
    return doc


def _log(pid, team, games):
    return {"player_id": pid, "gameLog": [{"gameId": g, "teamAbbrev": team, "gameDate": d, "powerPlayPoints": 1, "toi": "10:00"} for g, d in games]}


def test_daily_update_and_rerun(spark, tmp_dir):
    # Local dates (US/Eastern): games 100 and 101 on 2025-11-01, game 99 on 2025-10-31.
    write_lines(f"{tmp_dir}/sched/all.json", [{"games": [
        game(99, 2, "2025-10-31T23:00:00Z", "BOS", "TOR", "OFF"),
        game(100, 2, "2025-11-01T23:00:00Z", "BOS", "TOR", "OFF"),
        game(101, 2, "2025-11-01T23:30:00Z", "MTL", "TOR", "LIVE"),
    ]}])
    write_lines(f"{tmp_dir}/box/b.json", [_box(99, "BOS", "TOR"), _box(100, "BOS", "TOR"), _box(101, "MTL", "TOR", "O")])
    write_lines(f"{tmp_dir}/logs/l.json", [
        _log(1, "TOR", [(99, "2025-10-31"), (100, "2025-11-01"), (101, "2025-11-01")]),
        _log(3, "TOR", [(100, "2025-11-01"), (101, "2025-11-01")]),
        _log(5, "BOS", [(100, "2025-11-01")]),
    ])
    paths = Paths(f"{tmp_dir}/sched", f"{tmp_dir}/box", f"{tmp_dir}/logs", f"{tmp_dir}/store")

    run_daily_update(spark, paths, "2025-11-02", season="20252026")
    sk = read_fact(spark, paths.store, "player_game_stats")
    gk = read_fact(spark, paths.store, "goalie_game_stats")
    assert sorted((r.game_id, r.player_id) for r in sk.collect()) == [(100, 1), (101, 1)]  # game 99 is not yesterday
    assert sorted((r.game_id, r.player_id) for r in gk.collect()) == [(100, 3), (100, 5), (101, 3)]
    reg = {r.game_id: r.status for r in read_current(spark, f"{paths.store}/register").collect()}
    assert reg == {100: "final", 101: "pending"}
    dim1 = {r.player_id: r for r in read_current(spark, f"{paths.store}/pro_players").collect()}
    assert dim1[1].season_games_played == 2 and dim1[3].is_goalie and dim1[3].season_wins == 1

    # Same day again: the final game is skipped, the pending one is re-landed; nothing changes.
    run_daily_update(spark, paths, "2025-11-02", season="20252026")
    dim2 = {r.player_id: tuple(r) for r in read_current(spark, f"{paths.store}/pro_players").collect()}
    assert dim2 == {k: tuple(v) for k, v in dim1.items()}
    assert read_fact(spark, paths.store, "player_game_stats").count() == 2

    # The dimension equals a full rebuild from the facts (re-read: the run
    # replaced the touched partitions in place).
    sk = read_fact(spark, paths.store, "player_game_stats")
    gk = read_fact(spark, paths.store, "goalie_game_stats")
    full = {r.player_id: r.season_games_played for r in D.season_snapshot(sk, gk, "20252026").collect()}
    assert {k: v.season_games_played for k, v in dim1.items()} == full


def test_landed_files_are_read_once_and_lines_enriched_once(spark, tmp_dir, monkeypatch):
    from rinkspark.sources import daily_update as U

    write_lines(f"{tmp_dir}/sched/all.json", [{"games": [game(100, 2, "2025-11-01T23:00:00Z", "BOS", "TOR", "OFF")]}])
    write_lines(f"{tmp_dir}/box/b.json", [_box(100, "BOS", "TOR")])
    write_lines(f"{tmp_dir}/logs/l.json", [_log(1, "TOR", [(100, "2025-11-01")]), _log(3, "TOR", [(100, "2025-11-01")])])
    paths = Paths(f"{tmp_dir}/sched", f"{tmp_dir}/box", f"{tmp_dir}/logs", f"{tmp_dir}/store")
    reads, stage = {}, U._stage

    def watched(df, store, name, *args, **kw):
        reads[name] = {part for f in df.inputFiles() for part in ("/box/", "/logs/", "/_staging/box-scores", "/_staging/lines") if part in f}
        return stage(df, store, name, *args, **kw)

    monkeypatch.setattr(U, "_stage", watched)
    run_daily_update(spark, paths, "2025-11-02", season="20252026")
    assert [n for n, r in reads.items() if "/box/" in r] == ["box-scores"]
    assert [n for n, r in reads.items() if "/logs/" in r] == ["lines"]
    assert reads["skater-batch"] >= {"/_staging/lines"} and reads["goalie-batch"] >= {"/_staging/lines"}
    assert read_fact(spark, paths.store, "player_game_stats").count() == read_fact(spark, paths.store, "goalie_game_stats").count() == 1


def test_streamed_box_scores_equal_batch(spark, tmp_dir):
    from rinkspark.sources.daily_update import stream_box_scores

    write_lines(f"{tmp_dir}/sched/all.json", [{"games": [
        game(100, 2, "2025-11-01T23:00:00Z", "BOS", "TOR", "OFF"),
        game(101, 2, "2025-11-02T23:30:00Z", "MTL", "TOR", "OFF"),
    ]}])
    write_lines(f"{tmp_dir}/box/a.json", [_box(100, "BOS", "TOR")])
    write_lines(f"{tmp_dir}/box/b.json", [_box(101, "MTL", "TOR", "O")])
    write_lines(f"{tmp_dir}/logs/l.json", [
        _log(1, "TOR", [(100, "2025-11-01"), (101, "2025-11-02")]),
        _log(3, "TOR", [(100, "2025-11-01"), (101, "2025-11-02")]),
    ])
    paths = Paths(f"{tmp_dir}/sched", f"{tmp_dir}/box", f"{tmp_dir}/logs", f"{tmp_dir}/store")
    stream_box_scores(spark, paths, season="20252026", max_files_per_trigger=1)
    sk = read_fact(spark, paths.store, "player_game_stats")
    gk = read_fact(spark, paths.store, "goalie_game_stats")
    assert sorted((r.game_id, r.player_id) for r in sk.collect()) == [(100, 1), (101, 1)]
    assert sorted((r.game_id, r.player_id) for r in gk.collect()) == [(100, 3), (101, 3)]
    dim = {r.player_id: r for r in read_current(spark, f"{paths.store}/pro_players").collect()}
    assert dim[1].season_games_played == 2 and (dim[3].season_wins, dim[3].season_ot_losses) == (1, 1)
    reg = {r.game_id: r.status for r in read_current(spark, f"{paths.store}/register").collect()}
    assert reg == {100: "final", 101: "final"}


def test_next_day_adds_partition_and_keeps_earlier_ones(spark, tmp_dir):
    write_lines(f"{tmp_dir}/sched/all.json", [{"games": [
        game(100, 2, "2025-11-01T23:00:00Z", "BOS", "TOR", "OFF"),
        game(102, 2, "2025-11-02T23:00:00Z", "TOR", "MTL", "OFF"),
    ]}])
    write_lines(f"{tmp_dir}/box/b.json", [_box(100, "BOS", "TOR"), _box(102, "TOR", "MTL")])
    write_lines(f"{tmp_dir}/logs/l.json", [
        _log(1, "TOR", [(100, "2025-11-01"), (102, "2025-11-02")]),
        _log(3, "TOR", [(100, "2025-11-01"), (102, "2025-11-02")]),
    ])
    paths = Paths(f"{tmp_dir}/sched", f"{tmp_dir}/box", f"{tmp_dir}/logs", f"{tmp_dir}/store")
    run_daily_update(spark, paths, "2025-11-02", season="20252026")
    day1 = sorted(tuple(r) for r in read_fact(spark, paths.store, "player_game_stats").collect())
    run_daily_update(spark, paths, "2025-11-03", season="20252026")
    sk = read_fact(spark, paths.store, "player_game_stats")
    assert sorted((r.game_id, r.player_id) for r in sk.collect()) == [(100, 1), (102, 1)]
    assert sorted(tuple(r) for r in sk.where("game_id = 100").collect()) == day1  # earlier day untouched
    dim = {r.player_id: r for r in read_current(spark, f"{paths.store}/pro_players").collect()}
    assert dim[1].season_games_played == 2 and dim[3].season_games_played == 2
    gk = read_fact(spark, paths.store, "goalie_game_stats")
    full = {r.player_id: r.season_games_played for r in D.season_snapshot(sk, gk, "20252026").collect()}
    assert {k: v.season_games_played for k, v in dim.items()} == full


def _landed(doc, at):
    return {**doc, "landed_at": at}


def test_corrections_moved_dates_and_stray_lines(spark, tmp_dir):
    paths = Paths(f"{tmp_dir}/sched", f"{tmp_dir}/box", f"{tmp_dir}/logs", f"{tmp_dir}/store")
    day = "2025-11-01T23:00:00Z"
    early, late = "2025-11-02T01:00:00Z", "2025-11-02T09:00:00Z"
    write_lines(f"{tmp_dir}/sched/a.json", [_landed({"games": [game(100, 2, day, "BOS", "TOR", "FUT")]}, early)], ["{broken"])
    write_lines(f"{tmp_dir}/box/a.json", [_landed(_box(100, "BOS", "TOR"), early)], ["not json"])
    logs = [_log(1, "TOR", [(100, "2025-11-01")]), _log(7, "TOR", [(100, "2025-11-01")])]  # 7 is in no box score
    write_lines(f"{tmp_dir}/logs/a.json", [_landed(x, early) for x in logs])
    run_daily_update(spark, paths, "2025-11-02")
    sk = read_fact(spark, paths.store, "player_game_stats").collect()
    assert [(r.game_id, r.player_id, r.goals, str(r.game_date)) for r in sk] == [(100, 1, 1, "2025-11-01")]
    assert {r.status for r in read_current(spark, f"{paths.store}/register").collect()} == {"pending"}
    dim = {r.player_id: r for r in read_current(spark, f"{paths.store}/pro_players").collect()}
    assert 7 not in dim and dim[1].is_active and dim[1].season_games_played == 1
    bad = spark.read.parquet(f"{paths.store}/_quarantine/boxscores/as_of=2025-11-02").collect()
    assert [r["_corrupt_record"] for r in bad] == ["not json"]

    # A lower score, a corrected date and the final state are landed later.
    fixed = _box(100, "BOS", "TOR")
    fixed["playerByGameStats"]["awayTeam"]["forwards"][0]["goals"] = 0
    write_lines(f"{tmp_dir}/sched/b.json", [_landed({"games": [game(100, 2, day, "BOS", "TOR", "OFF")]}, late)])
    write_lines(f"{tmp_dir}/box/b.json", [_landed(fixed, late)])
    write_lines(f"{tmp_dir}/logs/b.json", [_landed(_log(1, "TOR", [(100, "2025-10-31")]), late)])
    for _ in range(2):  # the second run finds the game final and changes nothing
        run_daily_update(spark, paths, "2025-11-02")
        sk = read_fact(spark, paths.store, "player_game_stats").collect()
        assert [(r.game_id, r.player_id, r.goals, str(r.game_date)) for r in sk] == [(100, 1, 0, "2025-10-31")]
        dim = {r.player_id: r for r in read_current(spark, f"{paths.store}/pro_players").collect()}
        assert dim[1].season_games_played == 1
    assert {r.status for r in read_current(spark, f"{paths.store}/register").collect()} == {"final"}


def test_merge_reads_touched_partitions_only(spark, tmp_dir):
    from rinkspark import schemas
    from rinkspark.sources.daily_update import fact_table, merge_into_partitions
    from rinkspark.sources.store import conform

    rows = [(g, 1, "2025", f"2025-11-{1 + g:02d}") for g in range(20)] + [(50, 1, None, None)]
    fact = conform(spark.createDataFrame(rows, "game_id long, player_id long, season string, game_date string"), schemas.PLAYER_GAME_STATS)
    merge_into_partitions(spark, fact, tmp_dir, "player_game_stats")
    again = conform(spark.createDataFrame([(50, 1, None, None), (3, 1, "2025", "2025-11-09")], "game_id long, player_id long, season string, game_date string"), schemas.PLAYER_GAME_STATS)
    table = fact_table(spark, tmp_dir, "player_game_stats")
    touched = table.partitions_of(again.select("game_id")).unionByName(again.select("season", "game_date")).distinct()
    files = table.read(touched).inputFiles()
    assert len(files) == 3 and all(any(d in f for d in ("2025-11-04", "2025-11-09", "__HIVE_DEFAULT")) for f in files)
    merge_into_partitions(spark, again, tmp_dir, "player_game_stats")
    table = read_fact(spark, tmp_dir, "player_game_stats")
    assert table.count() == 21 and {str(r.game_date) for r in table.where("game_id = 3").collect()} == {"2025-11-09"}


def test_stream_keeps_broken_lines_and_newer_landings(spark, tmp_dir):
    """An older landing in a later micro-batch replaces nothing; a line that
    does not parse is in the quarantine of its batch."""
    from rinkspark.sources.daily_update import stream_box_scores

    write_lines(f"{tmp_dir}/sched/all.json", [{"games": [game(100, 2, "2025-11-01T23:00:00Z", "BOS", "TOR", "OFF")]}])
    write_lines(f"{tmp_dir}/logs/l.json", [_log(1, "TOR", [(100, "2025-11-01")])])
    old, new = _box(100, "BOS", "TOR"), _box(100, "BOS", "TOR")
    new["playerByGameStats"]["awayTeam"]["forwards"][0]["goals"] = 4
    paths = Paths(f"{tmp_dir}/sched", f"{tmp_dir}/box", f"{tmp_dir}/logs", f"{tmp_dir}/store")
    for name, doc, at, broken in (("a", new, "2025-11-02T09:00:00Z", ["{broken"]), ("b", old, "2025-11-02T01:00:00Z", [])):
        write_lines(f"{tmp_dir}/box/{name}.json", [_landed(doc, at)], broken)
        stream_box_scores(spark, paths, season="20252026")
        assert [(r.game_id, r.player_id, r.goals) for r in read_fact(spark, paths.store, "player_game_stats").collect()] == [(100, 1, 4)]
    bad = spark.read.parquet(f"{paths.store}/_quarantine/boxscores").collect()
    assert [(r["_corrupt_record"], r["batch"]) for r in bad] == [("{broken", 0)]


def test_season_seed_equals_daily_runs_and_prior_season(spark, tmp_dir):
    from rinkspark.sources.daily_update import run_prior_season, run_season_seed

    write_lines(f"{tmp_dir}/sched/all.json", [{"games": [
        game(100, 2, "2025-11-01T23:00:00Z", "BOS", "TOR", "OFF"),
        game(102, 2, "2025-11-02T23:00:00Z", "TOR", "MTL", "OFF"),
        game(104, 2, "2025-11-04T23:00:00Z", "TOR", "MTL", "FUT"),
    ]}])
    write_lines(f"{tmp_dir}/box/b.json", [_box(100, "BOS", "TOR"), _box(102, "TOR", "MTL"), _box(104, "TOR", "MTL")])
    write_lines(f"{tmp_dir}/logs/l.json", [_log(p, "TOR", [(100, "2025-11-01"), (102, "2025-11-02"), (104, "2025-11-04")]) for p in (1, 3)])
    daily = Paths(f"{tmp_dir}/sched", f"{tmp_dir}/box", f"{tmp_dir}/logs", f"{tmp_dir}/daily")
    seed = Paths(f"{tmp_dir}/sched", f"{tmp_dir}/box", f"{tmp_dir}/logs", f"{tmp_dir}/seed")
    for day in ("2025-11-02", "2025-11-03"):
        run_daily_update(spark, daily, day)
    run_season_seed(spark, seed, "2025-11-03")

    def rows(store, name):
        return sorted(tuple(r) for r in read_fact(spark, store, name).collect())

    for name in ("player_game_stats", "goalie_game_stats"):
        assert rows(daily.store, name) == rows(seed.store, name) and rows(seed.store, name)

    def dim(store):
        return sorted(read_current(spark, f"{store}/pro_players").drop("updated_at").collect(), key=lambda r: r.player_id)

    assert dim(daily.store) == dim(seed.store)
    run_prior_season(spark, seed.store, "20252026")
    after = {r.player_id: r for r in dim(seed.store)}
    assert after[1].prior_season_games_played == 2 and after[1].season_games_played == 2
