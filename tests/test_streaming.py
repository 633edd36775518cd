"""Streaming totals: equal to batch, replay-safe, late corrections win."""

import datetime as dt

from pyspark.sql import functions as F

from rinkspark.streaming.totals import final_totals, run_incremental_totals

SCHEMA = "game_id long, player_id long, ts timestamp, total_fpts double, landed_at int"


def land(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)


def test_stream_equals_batch_and_corrections(spark, tmp_dir):
    t = dt.datetime(2025, 11, 1)
    src = f"{tmp_dir}/landing"
    land(spark, src, [(1, 1, t, 2.0, 1), (2, 1, t, 3.0, 1), (3, 2, t, 1.0, 1)])
    land(spark, src, [(2, 1, t, 3.0, 1), (4, 2, t, 4.0, 2)])  # duplicate delivery of game 2
    land(spark, src, [(3, 2, t, 5.0, 3)])  # late correction of game 3
    schema = spark.read.parquet(src).schema
    root = run_incremental_totals(spark, src, schema, version_col="landed_at", max_files_per_trigger=1, root=f"{tmp_dir}/run")
    got = {r.player_id: (r.games, float(r.total_points)) for r in final_totals(spark, root).collect()}
    assert got == {1: (2, 5.0), 2: (2, 9.0)}
    # replay: running again over the same checkpoint adds no batch and changes nothing
    run_incremental_totals(spark, src, schema, version_col="landed_at", max_files_per_trigger=1, root=f"{tmp_dir}/run")
    again = {r.player_id: (r.games, float(r.total_points)) for r in final_totals(spark, root).collect()}
    assert again == got


def test_watermark_dedup(spark, tmp_dir):
    t = dt.datetime(2025, 11, 1)
    src = f"{tmp_dir}/landing2"
    land(spark, src, [(1, 1, t, 2.0, 1)])
    land(spark, src, [(1, 1, t, 2.0, 1), (2, 1, t + dt.timedelta(hours=1), 1.0, 1)])
    schema = spark.read.parquet(src).schema
    root = run_incremental_totals(spark, src, schema, watermark=("ts", "1 day"), max_files_per_trigger=1, root=f"{tmp_dir}/run2")
    r = final_totals(spark, root).where(F.col("player_id") == 1).first()
    assert (r.games, float(r.total_points)) == (2, 3.0)


def test_batches_write_what_they_touch_and_compact(spark, tmp_dir, monkeypatch):
    """A batch writes the totals of its players only; compaction and a replay of
    the last batch change nothing."""
    from pyspark.sql import functions as F

    from rinkspark.streaming import totals as X

    monkeypatch.setattr(X, "COMPACT", 3)
    source, root = f"{tmp_dir}/landing", f"{tmp_dir}/work"
    schema = spark.createDataFrame([], "game_id long, player_id long, total_fpts double").schema
    for n in range(5):
        low, high = (0, 200) if n == 0 else (n, n + 2)  # a wide first batch, then two players each
        spark.range(low, high).selectExpr(f"id + {1000 * n} AS game_id", "id AS player_id", f"CAST(id + {n} AS DOUBLE) / 8 AS total_fpts").coalesce(1).write.mode("append").parquet(source)
        X.run_incremental_totals(spark, source, schema, root=root)
        if n:
            assert spark.read.parquet(f"{root}/totals/delta-{n}").count() == 2
    batch = spark.read.parquet(source)
    want = {r.player_id: (r.games, float(r.total_points)) for r in batch.groupBy("player_id").agg(F.count("*").alias("games"), F.sum("total_fpts").alias("total_points")).collect()}

    def got():
        return {r.player_id: (r.games, float(r.total_points)) for r in X.final_totals(spark, root).collect()}

    assert got() == want and len(want) == 200
    assert X._folders(spark, f"{root}/totals") == ["base-3", "delta-4"] and X._folders(spark, f"{root}/totals", below=4) == ["base-3"]


def test_corrections_across_micro_batches(spark, tmp_dir):
    import datetime as dt

    from rinkspark.streaming.totals import corrected, run_corrections

    t, h = dt.datetime(2025, 11, 1), lambda k: dt.datetime(2025, 12, 1, k)
    schema = spark.createDataFrame([], "game_id long, player_id long, ts timestamp, landed_at timestamp, points int").schema
    batches = [
        [(1, 1, t, h(2), 5), (1, 1, t, h(2), 5), (2, 1, t + dt.timedelta(days=9), h(2), 7)],
        [(1, 1, t, h(1), 4), (2, 1, t + dt.timedelta(days=9), h(3), 8)],  # game 1: older, and too late by now
        [(3, 1, t + dt.timedelta(days=1), h(5), 1), (4, 1, t + dt.timedelta(days=8), h(5), 2), (2, 1, t + dt.timedelta(days=9), h(1), 0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/landing")
        run_corrections(spark, f"{tmp_dir}/landing", schema, f"{tmp_dir}/work", delay="2 days")
    got = sorted((r.game_id, r.points) for r in corrected(spark, f"{tmp_dir}/work", schema).collect())
    assert got == [(1, 5), (2, 8), (4, 2)]  # game 3 is eight days behind the latest
