"""Atomic commits, the key index and versions of a partitioned table."""

import datetime as dt
import random

import pytest

from rinkspark.sources import manifest as M

SCHEMA = "game_id long, player_id long, season string, day date, goals int"


def table(spark, root, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return M.PartitionedTable(spark, root, schema, key=["game_id", "player_id"], partition_by=["season", "day"], index_on="game_id", buckets=4, **more)


def rows(spark, data, version=False):
    return spark.createDataFrame(data, SCHEMA + (", landed_at timestamp" if version else ""))


def held(t):
    return sorted((tuple(r) for r in t.read().collect()), key=str)


D = [dt.date(2025, 11, k) for k in range(1, 9)]


def test_merges_equal_a_dictionary(spark, tmp_dir):
    rng, want, t = random.Random(2), {}, table(spark, f"{tmp_dir}/t")
    assert not t.exists() and t.read().count() == 0
    for _ in range(5):
        batch = {}
        for _ in range(12):
            key = (rng.randrange(8), rng.randrange(3))
            batch[key] = (*key, rng.choice(["2024", "a b/c=1", None]), rng.choice([*D, None]), rng.randrange(9))
        want.update(batch)
        t.merge(rows(spark, list(batch.values())))
        assert held(t) == sorted(want.values(), key=str)
        assert held(table(spark, f"{tmp_dir}/t", max_listed=0)) == held(t)  # the way for very many partitions
        live = t.manifest().filter("kind = 'data'")
        assert live.select("season", "day").distinct().count() == live.count() == len({r[2:4] for r in want.values()})


def test_a_job_that_dies_leaves_the_old_table(spark, tmp_dir, monkeypatch):
    t = table(spark, f"{tmp_dir}/t")
    t.merge(rows(spark, [(1, 1, "2025", D[0], 1), (2, 1, "2025", D[1], 1)]))
    before, opened = held(t), t.read()
    again = rows(spark, [(1, 1, "2025", D[5], 7)])
    for step in ("_write_pointer", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(M if step == "_write_pointer" else M.PartitionedTable, step, lambda *a: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError, match="gone"):
                t.merge(again)
        assert held(t) == before
    t.merge(again)
    after = held(t)
    assert after == sorted([(1, 1, "2025", D[5], 7), (2, 1, "2025", D[1], 1)], key=str)
    assert sorted((tuple(r) for r in opened.collect()), key=str) == before  # a reader keeps what it opened


def test_large_batch_reads_touched_partitions_only(spark, tmp_dir):
    """20,000 games of one day among 300 days: the old rows are found through
    the index, and one partition is read."""
    t = table(spark, f"{tmp_dir}/t")
    base = spark.range(60_000).selectExpr("id AS game_id", "1L AS player_id", "'2025' AS season", "date_add(DATE'2025-01-01', CAST(id DIV 20000 AS INT) * 100 + CAST(id % 2 AS INT)) AS day", "1 AS goals")
    t.merge(base)
    batch = base.filter("game_id < 20000").selectExpr("game_id", "player_id", "season", "day", "2 AS goals")
    touched = t.partitions_of(batch.select("game_id"))
    assert touched.count() == 2
    assert {f.split("day=")[1].split("/")[0] for f in t.read(touched).inputFiles()} == {"2025-01-01", "2025-01-02"}
    t.merge(batch)
    assert {(r.goals, r["n"]) for r in t.read().groupBy("goals").count().withColumnRenamed("count", "n").collect()} == {(2, 20_000), (1, 40_000)}
    commits = {r.day.isoformat(): r["commit"] for r in t.manifest().filter("kind = 'data'").collect()}
    assert len(commits) == 6 and len({commits["2025-01-01"], commits["2025-01-02"]}) == 1 and len(set(commits.values())) == 2


def test_versions(spark, tmp_dir):
    t = table(spark, f"{tmp_dir}/t", version="landed_at")
    at = [dt.datetime(2025, 11, 1, h) for h in range(4)]
    t.merge(rows(spark, [(1, 1, "s", D[0], 1, at[2]), (2, 1, "s", D[0], 1, None), (3, 1, "s", D[0], 1, at[1])], True))
    t.merge(rows(spark, [(1, 1, "s", D[1], 9, at[1]), (2, 1, "s", D[1], 9, at[0]), (3, 1, "s", D[1], 9, at[1]), (3, 1, "s", D[2], 8, at[0])], True))
    assert held(t) == sorted([(1, 1, "s", D[0], 1), (2, 1, "s", D[1], 9), (3, 1, "s", D[1], 9)], key=str)


def test_merge_into_a_new_table_reduces_the_batch_once(spark, tmp_dir, monkeypatch):
    calls = []
    latest = M.latest_per_key
    monkeypatch.setattr(M, "latest_per_key", lambda df, *a: calls.append(1) or latest(df, *a))
    t = table(spark, f"{tmp_dir}/t")
    t.merge(rows(spark, [(1, 1, "2025", D[0], 1), (1, 1, "2025", D[0], 2), (None, 1, "2025", D[1], 3)]))
    assert len(calls) == 1  # the second pass shuffled every row again, with nothing to meet
    assert held(t) == sorted([(1, 1, "2025", D[0], 2), (None, 1, "2025", D[1], 3)], key=str)
    t.merge(rows(spark, [(1, 1, "2025", D[2], 4)]))
    assert len(calls) == 3 and len(held(t)) == 2
