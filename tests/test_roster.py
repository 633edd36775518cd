"""Batch roster moves: validity, all-or-nothing trades, conflicts."""

import datetime as dt
import random

import pytest

from rinkspark.operators import roster as R

MOVES = "move_id long, move_ts timestamp, kind string, team_id long, other_team_id long, send array<long>, receive array<long>"


def players(spark):
    return spark.createDataFrame(
        [(1, 10), (2, 10), (3, 20), (4, None), (5, None)], "player_id long, fantasy_team_id long"
    )


def run(spark, moves):
    t = dt.datetime(2025, 11, 1)
    rows = [(i, t + dt.timedelta(minutes=i), *m) for i, m in enumerate(moves)]
    after, dec = R.apply_roster_moves(players(spark), spark.createDataFrame(rows, MOVES))
    return {r.player_id: r.fantasy_team_id for r in after.collect()}, {r.move_id: (r.accepted, r.reason) for r in dec.collect()}


def test_add_drop(spark):
    after, dec = run(spark, [("add", 20, None, [], [4]), ("add", 20, None, [], [1]), ("drop", 10, None, [2], []),
                             ("drop", 20, None, [1], []), ("add", 20, None, [], [99])])
    assert dec == {0: (True, None), 1: (False, "wrong_team"), 2: (True, None), 3: (False, "wrong_team"),
                   4: (False, "unknown_player")}
    assert after == {1: 10, 2: None, 3: 20, 4: 20, 5: None}


def test_trade_all_or_nothing(spark):
    after, dec = run(spark, [("trade", 10, 20, [1, 4], [3]), ("trade", 10, 20, [1], [3]),
                             ("trade", 10, 10, [1], [2]), ("trade", 10, 20, [], [3])])
    assert dec[0] == (False, "wrong_team")  # player 4 is not on team 10: whole trade rejected
    assert dec[1] == (True, None)
    assert dec[2] == (False, "invalid_move") and dec[3] == (False, "invalid_move")
    assert after[1] == 20 and after[3] == 10 and after[4] is None
    # the number of rostered players is unchanged by a trade
    assert sum(v is not None for v in after.values()) == 3


def test_conflict_earliest_wins(spark):
    _, dec = run(spark, [("add", 20, None, [], [5]), ("add", 10, None, [], [5])])
    assert dec == {0: (True, None), 1: (False, "conflict")}


def test_create_and_reset(spark):
    teams = spark.createDataFrame([(3, "A", "x")], "team_id long, team_name string, owner_name string")
    t = dt.datetime(2025, 11, 1)
    req = spark.createDataFrame(
        [(1, t, " New ", "o"), (2, t, "", "o"), (3, t + dt.timedelta(1), "Other", "p")],
        "move_id long, move_ts timestamp, team_name string, owner_name string",
    )
    out, bad = R.create_teams(teams, req)
    assert sorted((r.team_id, r.team_name) for r in out.collect()) == [(3, "A"), (4, "New"), (5, "Other")]
    assert [r.move_id for r in bad.collect()] == [2]
    p2, t2 = R.reset_rosters(players(spark), teams)
    assert t2.count() == 0 and p2.where("fantasy_team_id is not null").count() == 0


def test_repeated_players_and_missing_teams(spark):
    after, dec = run(spark, [("trade", 10, 20, [1, 1], [3]), ("drop", None, None, [4], []), ("add", None, None, [], [4]), ("trade", 10, 20, [1], [1])])
    assert all(d == (False, "invalid_move") for d in dec.values())
    assert after == {1: 10, 2: 10, 3: 20, 4: None, 5: None}


def test_team_table_and_moves_without_time(spark):
    t = dt.datetime(2025, 11, 1)
    rows = [(1, t, "add", 999, None, [], [4]), (2, None, "add", 10, None, [], [5]), (3, t, "add", 20, None, [], [5])]
    teams = spark.createDataFrame([(10,), (20,)], "team_id long")
    after, dec = R.apply_roster_moves(players(spark), spark.createDataFrame(rows, MOVES), teams)
    got = {r.move_id: (r.accepted, r.reason) for r in dec.collect()}
    assert got == {1: (False, "unknown_team"), 2: (False, "conflict"), 3: (True, None)}
    assert {r.player_id: r.fantasy_team_id for r in after.collect()}[5] == 20


def test_requests_without_a_time_come_last(spark):
    t = dt.datetime(2025, 11, 1)
    teams = spark.createDataFrame([(3, "A", "x")], "team_id long, team_name string, owner_name string")
    req = spark.createDataFrame([(1, None, "Late", "o"), (2, t, "First", "o")], "move_id long, move_ts timestamp, team_name string, owner_name string")
    out, bad = R.create_teams(teams, req)
    assert sorted((r.team_id, r.team_name) for r in out.collect()) == [(3, "A"), (4, "First"), (5, "Late")] and bad.count() == 0


def one_by_one(snapshot, moves):
    """The moves made in order, each against what the earlier ones left."""
    now, accepted = dict(snapshot), {}
    for move_id, ts, kind, team, other, send, receive in sorted(moves, key=lambda m: (m[1] is None, m[1] or dt.datetime.min, m[0])):
        pairs = {"add": [(p, None, team) for p in receive], "drop": [(p, team, None) for p in send]}.get(kind)
        if pairs is None:
            pairs = [(p, team, other) for p in send] + [(p, other, team) for p in receive]
        accepted[move_id] = all(p in now and now[p] == a for p, a, _ in pairs)
        if accepted[move_id]:
            now.update({p: b for p, _, b in pairs})
    return now, accepted


@pytest.mark.parametrize("seed", range(4))
def test_batch_equals_moves_one_by_one(spark, seed):
    rng = random.Random(seed)
    snapshot = {p: rng.choice([10, 20, 30, None]) for p in range(1, 9)}
    moves, t = [], dt.datetime(2025, 11, 1)
    for i in range(60):
        kind, team = rng.choice(["add", "drop", "trade", "trade"]), rng.choice([10, 20, 30])
        other = rng.choice([x for x in (10, 20, 30) if x != team])
        p = rng.sample(range(1, 9), 3)
        send, receive = ([], p[:1]) if kind == "add" else (p[:1], []) if kind == "drop" else (p[: rng.choice([1, 2])], p[2:])
        moves.append((i, rng.choice([None, *[t + dt.timedelta(minutes=rng.randrange(30))] * 5]), kind, team, other if kind == "trade" else None, send, receive))
    after, dec = R.apply_roster_moves(
        spark.createDataFrame(list(snapshot.items()), "player_id long, fantasy_team_id long"), spark.createDataFrame(moves, MOVES)
    )
    now, accepted = one_by_one(snapshot, moves)
    assert {r.move_id: r.accepted for r in dec.collect()} == accepted and 2 < sum(accepted.values()) < 55
    assert {r.player_id: r.fantasy_team_id for r in after.collect()} == now


def test_a_losing_trade_blocks_nobody(spark):
    after, dec = run(spark, [("drop", 10, None, [1], []), ("trade", 10, 20, [1, 2], [3]), ("trade", 10, 20, [2], [3]), ("add", 20, None, [], [1])])
    assert dec == {0: (True, None), 1: (False, "conflict"), 2: (True, None), 3: (True, None)}
    assert after == {1: 20, 2: 20, 3: 10, 4: None, 5: None}


def test_missing_and_repeated_move_ids(spark):
    t = dt.datetime(2025, 11, 1)
    rows = [(3, t, "add", 10, None, [], [4]), (3, t, "add", 20, None, [], [4]), (None, t, "drop", 10, None, [1], []), (None, t, "drop", 20, None, [3], []), (5, t, "add", 20, None, [], [5])]
    after, dec = R.apply_roster_moves(players(spark), spark.createDataFrame(rows, MOVES))
    assert sorted((r.move_id or 0, r.accepted, r.reason or "") for r in dec.collect()) == [(0, False, "invalid_move")] * 2 + [(3, False, "invalid_move")] * 2 + [(5, True, "")]
    got = after.collect()
    assert len(got) == 5 and {r.player_id: r.fantasy_team_id for r in got} == {1: 10, 2: 10, 3: 20, 4: None, 5: 20}
    empty, none = R.apply_roster_moves(players(spark), spark.createDataFrame([], MOVES))
    assert empty.count() == 5 and none.count() == 0
