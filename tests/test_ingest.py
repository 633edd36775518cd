"""Landed JSON and CSV -> facts, on small files written to a scratch folder."""

import json
import os

from rinkspark.sources import ingest as I
from rinkspark.sources import landed as L


def write_lines(path, docs, extra_lines=()):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        for d in docs:
            fh.write(json.dumps(d) + "\n")
        for line in extra_lines:
            fh.write(line + "\n")
    return path


def team(abbrev, name):
    return {"abbrev": abbrev, "commonName": {"default": name}}


def game(gid, gtype, start, home, away, state="OFF", season=20252026):
    return {"id": gid, "season": season, "gameType": gtype, "startTimeUTC": start, "gameState": state,
            "homeTeam": team(home, home + " name"), "awayTeam": team(away, away + " name")}


def test_schedule_filter_and_unique(spark, tmp_dir):
    p = f"{tmp_dir}/sched"
    write_lines(f"{p}/BOS.json", [{"games": [game(1, 1, "2025-10-01T23:00:00Z", "BOS", "TOR"),
                                            game(2, 2, "2025-10-10T23:00:00Z", "BOS", "TOR"),
                                            game(3, 3, "2026-04-30T23:00:00Z", "BOS", "TOR")]}])
    write_lines(f"{p}/TOR.json", [{"games": [game(2, 2, "2025-10-10T23:00:00Z", "BOS", "TOR")]}], ["{broken"])
    g = L.unique_games(L.regular_season(L.read_schedules(spark, p)))
    rows = g.collect()
    assert [r.game_id for r in rows] == [2]
    assert rows[0].home_name == "BOS name" and str(rows[0].start_time_utc) == "2025-10-10 23:00:00"
    from rinkspark import schemas

    L.write_quarantine(L.read_json(spark, p, schemas.SCHEDULE), f"{tmp_dir}/quarantine")
    bad = spark.read.parquet(f"{tmp_dir}/quarantine").collect()
    assert [r._corrupt_record for r in bad] == ["{broken"]


def test_register_and_games_to_process(spark):
    games = spark.createDataFrame([(1, "OFF"), (2, "LIVE"), (3, "FUT")], "game_id long, game_state string")
    reg = L.register_entries(games.where("game_id < 3"))
    todo = L.games_to_process(games.select("game_id"), reg)
    assert sorted(r.game_id for r in todo.collect()) == [2, 3]


def skater(pid, name, pos, goals=0, assists=0, sog=0):
    return {"playerId": pid, "name": {"default": name}, "position": pos, "goals": goals, "assists": assists,
            "sog": sog, "blockedShots": 1, "hits": 2, "sweaterNumber": 9}


def goalie(pid, name, saves, ga, decision):
    return {"playerId": pid, "name": {"default": name}, "position": "G", "saves": saves, "savePctg": 0.9,
            "goalsAgainst": ga, "decision": decision, "sweaterNumber": 30}


def box_doc():
    return {
        "id": 100, "gameDate": "2025-11-01", "awayTeam": {"abbrev": "TOR"}, "homeTeam": {"abbrev": "BOS"},
        "playerByGameStats": {
            "awayTeam": {"forwards": [skater(1, "Away F", "C", 1, 0, 3)], "defense": [skater(2, "Away D", "D")],
                         "goalies": [goalie(3, "Away G", 30, 0, "W")]},
            "homeTeam": {"forwards": [skater(4, "Home F", "L")], "defense": [],
                         "goalies": [goalie(5, "Home G", 25, None, "L")]},
        },
    }


def test_six_arrays_in_order(spark, tmp_dir):
    p = write_lines(f"{tmp_dir}/box/100.json", [box_doc()])
    lines = L.box_lines(L.read_boxscores(spark, p)).orderBy("slot").collect()
    assert [(r.side, r.group, r.player_id) for r in lines] == [
        ("away", "forwards", 1), ("away", "defense", 2), ("away", "goalies", 3),
        ("home", "forwards", 4), ("home", "goalies", 5),
    ]
    assert lines[2].saves == 30 and lines[0].goals == 1 and lines[0].saves is None


def test_enrich_and_route(spark, tmp_dir):
    box = L.read_boxscores(spark, write_lines(f"{tmp_dir}/box/100.json", [box_doc()]))
    logs = [
        {"player_id": 1, "gameLog": [{"gameId": 100, "teamAbbrev": "TOR", "gameDate": "2025-11-01", "powerPlayPoints": 1,
                                       "shorthandedPoints": 0, "toi": "12:34", "shifts": 20}]},
        {"player_id": 3, "gameLog": [{"gameId": 100, "teamAbbrev": "TOR", "gameDate": "2025-11-01", "toi": "60:00"}]},
        {"player_id": 5, "gameLog": [{"gameId": 100, "teamAbbrev": "BOS", "gameDate": "2025-11-01"}]},
        {"player_id": 9, "gameLog": [{"gameId": 100, "teamAbbrev": "XXX", "gameDate": "2025-11-01", "toi": "bad"},
                                      {"gameId": 999, "teamAbbrev": "TOR", "gameDate": "2025-11-02"}]},
    ]
    log = L.read_player_logs(spark, write_lines(f"{tmp_dir}/logs/l.json", logs))
    seasons = spark.createDataFrame([(100, "20252026")], "game_id long, season string")
    sk, gk = I.build_facts(spark, log, box, seasons=seasons)
    s = {r.player_id: r for r in sk.collect()}
    g = {r.player_id: r for r in gk.collect()}
    # log + box merged; box-only players (2, 4) dropped; game 999 has no box score
    assert set(s) == {1, 9} and set(g) == {3, 5}
    assert s[1].toi_seconds == 754 and s[1].opponent_abbrev == "BOS" and s[1].team_name == "Toronto Maple Leafs"
    assert s[1].total_fpts == 3.5 and s[1].shooting_pct == 1 / 3 and s[1].season == "20252026"
    assert (s[9].player_name, s[9].position, s[9].team_name, s[9].toi_seconds) == ("N/A", "N/A", "Unknown", 0)
    assert s[9].opponent_abbrev == "BOS" and s[9].shooting_pct is None
    assert (g[3].wins, g[3].shutouts, g[3].total_fpts, g[3].position) == (1, 1, 13.0, "Goalie")
    assert (g[5].goals_against, g[5].shutouts, g[5].total_fpts) == (0, 0, 5.0)  # null against: no shutout
    dq = I.unmatched_team_count(I.enrich(log, L.box_lines(box), L.box_headers(box), I.team_map(spark)))
    assert (dq.first()["n_lines"], dq.first()["unmatched_team_lines"]) == (4, 1)


def test_weekly_csv(spark, tmp_dir):
    p = f"{tmp_dir}/weekly.csv"
    with open(p, "w") as fh:
        fh.write("Team,Week,Monday_Date,Sunday_Date,Game_Count,Opponents\n")
        fh.write('BOS,2025-W46,2025-11-10,2025-11-16,2,"@ DAL, vs WPG"\n')
    r = L.read_weekly_csv(spark, p).first()
    assert (r.team, r.game_count, r.opponents, str(r.monday_date)) == ("BOS", 2, "@ DAL, vs WPG", "2025-11-10")


def test_land_facts_by_season(spark, tmp_dir):
    from rinkspark import schemas
    from rinkspark.sources.store import conform

    def fact(rows):
        df = spark.createDataFrame(rows, "game_id long, player_id long, season string, total_fpts double")
        return conform(df, schemas.PLAYER_GAME_STATS)

    def gfact(rows):
        df = spark.createDataFrame(rows, "game_id long, player_id long, season string, total_fpts double")
        return conform(df, schemas.GOALIE_GAME_STATS)

    I.land_facts(fact([(1, 1, "20242025", 1.0), (2, 1, "20252026", 2.0)]), gfact([(3, 2, "20252026", 4.0)]), tmp_dir)
    I.land_facts(fact([(9, 1, "20252026", 9.0)]), gfact([(8, 2, "20252026", 8.0)]), tmp_dir)
    got = sorted((r.game_id, str(r.season)) for r in spark.read.parquet(f"{tmp_dir}/player_game_stats").collect())
    assert got == [(1, "20242025"), (9, "20252026")]


def test_team_maps_both_ways(spark):
    df = spark.createDataFrame([("Montréal Canadiens",), ("Nowhere",)], "team_name string")
    out = {r.team_name: r.team_abbrev for r in I.with_team_code(df, I.team_code_map(spark)).collect()}
    assert out == {"Montréal Canadiens": "MTL", "Nowhere": None}
    assert I.team_map(spark).count() == I.team_code_map(spark).count() == 32


def test_register_payload_replays_what_was_landed(spark, tmp_dir):
    """Box scores and log lines come back from the VARIANT, of the last landing."""
    docs = []
    for gid, goals, at in ((1, 3, "2025-11-02T01:00:00Z"), (1, 2, "2025-11-03T01:00:00Z"), (2, 1, "2025-11-02T01:00:00Z")):
        doc = {**box_doc(), "id": gid, "landed_at": at}
        doc["playerByGameStats"]["awayTeam"]["forwards"][0]["goals"] = goals
        docs.append(doc)
    log = spark.createDataFrame([(1, 1, "10:00", None), (1, 3, "é", 4), (9, 1, "x", 1)], "game_id long, player_id long, toi string, shifts int")
    root = f"{tmp_dir}/register"
    for n, part in enumerate((docs[:1] + docs[2:], docs[1:2])):
        write_lines(f"{tmp_dir}/box-{n}/b.json", part)
        L.register_payload(L.read_boxscores(spark, f"{tmp_dir}/box-{n}"), log).write.mode("append").parquet(root)
    box, lines = L.replay_payload(spark.read.parquet(root), log.schema)
    want = L.read_boxscores(spark, f"{tmp_dir}/box-*")
    assert sorted(L.box_lines(box).collect(), key=str) == sorted(L.box_lines(want).collect(), key=str)
    assert sorted(L.box_headers(box).collect()) == sorted(L.box_headers(want).collect())
    assert sorted(tuple(r) for r in lines.collect()) == [(1, 1, "10:00", None), (1, 3, "é", 4)]


def test_line_tables_are_dealt_by_row_count(spark, tmp_dir, monkeypatch):
    # AQE merges default partitions up to a size in compressed bytes; a number of partitions from the row count stays.
    from rinkspark.operators import joins
    from rinkspark.plans import ingest_queries as Q

    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_dir}/nation.parquet")
    spark.createDataFrame([(1, "s", 0, 5000.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_dir}/supplier.parquet")
    orders = spark.range(45).selectExpr("id o_orderkey", "timestamp_ntz'1997-01-02 00:00:00' o_orderdate")
    orders.write.parquet(f"{tmp_dir}/orders.parquet")
    lines = "o_orderkey l_orderkey, 1L l_suppkey, 1 l_linenumber, 2D l_quantity, 0.1D l_discount, 0.2D l_tax, 'R' l_returnflag, 'F' l_linestatus"
    orders.selectExpr(*lines.split(", ")).write.parquet(f"{tmp_dir}/lineitem.parquet")
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 10)
    for rows in (Q.log_lines(spark, tmp_dir), Q.box_lines(spark, tmp_dir)):
        assert rows.rdd.getNumPartitions() == 5
        assert rows.count() == 45


def test_replay_moves_each_payload_once(spark):
    register = spark.sql(
        "SELECT * FROM VALUES (1L, NULL, 'a'), (1L, timestamp'2024-01-01 00:00:00', 'b'), (1L, timestamp'2024-01-02 00:00:00', 'c'), (2L, NULL, 'd'), (NULL, NULL, 'e')"
        " AS t(game_id, landed_at, v)"
    )
    doc = "concat('{\"box\":{\"id\":', game_id, ',\"gameDate\":\"', v, '\"},\"lines\":[{\"player_id\":7}]}')"
    register = register.selectExpr("game_id", "landed_at", f"parse_json({doc}) payload")
    log_schema = spark.sql("SELECT 1L game_id, 1L player_id").schema
    box, lines = L.replay_payload(register, log_schema)
    # The payloads were joined to the last landing times, then dealt again for one row per game.
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.id, r.gameDate, r.landed_at is None) for r in box.collect()) == [(1, "c", False), (2, "d", True)]
    assert sorted(tuple(r) for r in lines.collect()) == [(1, 7), (2, 7)]


def test_landed_documents_are_compressed(spark, tmp_dir, monkeypatch):
    import glob

    from rinkspark.plans import landing_queries as P

    monkeypatch.setattr(P, "work_root", lambda spark, name: f"{tmp_dir}/{name}")
    monkeypatch.setattr(P, "DOCS_PER_FILE", 2)
    docs = spark.range(6).coalesce(1)
    path = P._land(spark, "docs", docs, docs)
    files = glob.glob(f"{path}/*.json*")
    assert len(files) == 6 and all(f.endswith(".json.gz") for f in files)
    assert spark.read.json(path).count() == 12


def test_last_landing_comes_back_from_its_text(spark, tmp_dir):
    from rinkspark import schemas

    late, same = "2025-11-03T01:00:00.123456Z", "2025-11-03T01:00:00.123457Z"
    odd = box_doc()
    odd.update(landed_at=same, awayTeam={}, homeTeam=None)
    odd["playerByGameStats"]["awayTeam"] = {"forwards": [], "defense": [None], "goalies": [{**goalie(3, 'é"\\\n', 1, 0, "W"), "savePctg": "NaN"}]}
    odd["playerByGameStats"]["homeTeam"]["forwards"][0]["name"] = {"default": "x", "fr": None}
    docs = [{**box_doc(), "landed_at": late}, odd, {**odd, "gameDate": "2025-10-31"}]
    docs += [{"id": 2, "landed_at": late}, {"id": 2, "landed_at": late, "playerByGameStats": {}}, {**box_doc(), "id": None}]
    path = write_lines(f"{tmp_dir}/box/b.json", docs)
    read, _ = L.split_corrupt(L.read_json(spark, path, schemas.BOXSCORE))
    for parts in (None, 3):
        last = L.latest_landing(read, "id", parts)
        assert last.columns == read.columns
        # The documents themselves were shuffled, beside their text.
        plan = last._jdf.queryExecution().executedPlan().toString()
        assert "max_by" not in plan and plan.count("Exchange hashpartitioning") == 1
        got = {r.id: r for r in last.collect()}
        want = {(r.id, r.gameDate, r.playerByGameStats is None): r for r in read.collect()}
        assert set(got) == {100, 2} and got[100].landed_at.microsecond == 123457
        assert str(got[100]) == str(want[100, "2025-11-01", False])  # of equal landings the greater text
        assert got[2] == want[2, None, False]


def test_bucketed_register_is_not_shuffled(spark, tmp_dir):
    from rinkspark.sources import store as ST

    docs = [{**box_doc(), "id": gid, "landed_at": "2025-11-02T01:00:00Z"} for gid in range(40)]
    docs[7].pop("playerByGameStats")
    log = spark.createDataFrame([(g % 50, p, f"{p}:00", None) for g in range(100) for p in (1, 3)], "game_id long, player_id long, toi string, shifts int")
    box = L.read_boxscores(spark, write_lines(f"{tmp_dir}/box-0/b.json", docs), 5)
    corrected = [{**d, "landed_at": "2025-11-03T01:00:00Z", "gameDate": "2025-11-05"} for d in docs[::2]]
    again = L.read_boxscores(spark, write_lines(f"{tmp_dir}/box-1/b.json", corrected), 5)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for rows in (box, again):
        L.register_payload(rows, log).write.mode("append").parquet(f"{tmp_dir}/plain")
    with ST.bucketed(spark, "game_id", 5) as tables:
        kept = tables.append(log.repartition(5, "game_id"), f"{tmp_dir}/log")
        for rows in (box, again):
            payload = L.register_payload(rows, kept)
            assert plan(payload).count("Exchange") == 1  # the documents, by game
            register = tables.append(payload, f"{tmp_dir}/register")
    names = {t.name for t in spark.catalog.listTables()}
    assert not any(n in names for n in tables.names.values())
    got, want = L.replay_payload(register, log.schema), L.replay_payload(spark.read.parquet(f"{tmp_dir}/plain"), log.schema)
    for x, y in zip(got, want, strict=True):
        assert "Exchange" not in plan(x) and "Exchange" in plan(y)
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    box, lines = got
    assert lines.count() == 160 and sorted((r.id, r.gameDate) for r in box.collect())[:2] == [(0, "2025-11-05"), (1, "2025-11-01")]
    header = spark.range(50).selectExpr("id game_id", "'BOS' home_abbrev", "'TOR' away_abbrev")
    # Neither side is broadcast by the size of its packed files.
    assert "Broadcast" not in plan(lines.join(header, "game_id").join(L.box_lines(box), ["game_id", "player_id"], "left"))


def test_register_replay_shuffles_no_payload(spark, tmp_dir, monkeypatch):
    from rinkspark.operators import joins
    from rinkspark.plans import landing_queries as P

    monkeypatch.setattr(joins, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(P, "work_root", lambda spark, name: f"{tmp_dir}/work/{name}")

    def table(name, df):
        df.write.parquet(f"{tmp_dir}/{name}.parquet")

    table("region", spark.sql("SELECT 0 r_regionkey, 'EUROPE' r_name"))
    table("nation", spark.range(25).selectExpr("cast(id AS int) n_nationkey", "concat('N', id) n_name", "0 n_regionkey"))
    table("customer", spark.sql("SELECT 1L c_custkey, 'c' c_name, 0 c_nationkey, 1D c_acctbal, 'BUILDING' c_mktsegment"))
    table("supplier", spark.range(3).selectExpr("id s_suppkey", "concat('s', id) s_name", "cast(id AS int) s_nationkey", "500D + 2000 * id s_acctbal"))
    orders = spark.range(12)
    status = "CASE WHEN id = 3 THEN 'P' ELSE 'F' END o_orderstatus"
    table("orders", orders.selectExpr("id o_orderkey", "1L o_custkey", status, "1D o_totalprice", "timestamp_ntz'1997-01-02 00:00:00' o_orderdate", "'5-LOW' o_orderpriority"))
    # Each order has two lines of a goalie, two of a skater and one that was not returned.
    lines = spark.range(60).selectExpr("id % 12 l_orderkey", "1L l_partkey", "(id DIV 12) % 3 l_suppkey", "cast(id DIV 12 AS int) + 1 l_linenumber", "4D l_quantity")
    more = "5D l_extendedprice, 0.1D l_discount, 0.2D l_tax, CASE WHEN l_suppkey = 2 THEN 'N' ELSE 'R' END l_returnflag, 'F' l_linestatus, timestamp_ntz'1997-02-01 00:00:00' l_shipdate"
    table("lineitem", lines.selectExpr("*", *more.split(", ")))
    out = P.register_replay(spark, tmp_dir)
    # Payloads were shuffled between the two steps of their grouping.
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [after for line, after in zip(plan, plan[1:]) if "functions=[max_by" in line]
    assert len(below) == 2 and all("partial_max_by" in line for line in below)
    got = sorted((r.game_id, r.player_id, r.player_name, r.position, r.goals, r.assists, r.shots) for r in out.collect())
    assert got == [(g, 1, "s1", "C", 2, 2, 8) for g in range(12) if g != 3]
