"""Append, overwrite, upserts, snapshots and contracts."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from rinkspark.sources import store as ST


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "g long, p long, v string")
    new = spark.createDataFrame([(1, 2, "B1", 1), (1, 2, "B2", 2), (3, 1, "d", 1)], "g long, p long, v string, ts int")
    out = ST.upsert(old, new, ["g", "p"], order_by=["ts"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "a"), (1, 2, "B2"), (2, 1, "c"), (3, 1, "d")]


def test_partial_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, name string, x double")
    new = spark.createDataFrame([(2, 20.0), (3, 30.0)], "k long, x double")
    out = sorted(tuple(r) for r in ST.partial_upsert(old, new, "k", ["x"]).collect())
    assert out == [(1, "a", 1.0), (2, "b", 20.0), (3, None, 30.0)]


def test_append_overwrite_and_partitions(spark, tmp_dir):
    p = f"{tmp_dir}/t"
    df = spark.createDataFrame([(1, "2024"), (2, "2025")], "id long, season string")
    assert ST.overwrite(df, p, partition_by=["season"]) == 0  # rows cleared
    assert ST.overwrite(df, p, partition_by=["season"]) == 2
    ST.append(df, p, partition_by=["season"])
    assert spark.read.parquet(p).count() == 4
    ST.overwrite_partitions(spark.createDataFrame([(9, "2025")], "id long, season string"), p, ["season"])
    got = sorted((r.id, str(r.season)) for r in spark.read.parquet(p).collect())
    assert got == [(1, "2024"), (1, "2024"), (9, "2025")]


def test_snapshots(spark, tmp_dir):
    root = f"{tmp_dir}/dim"
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    ST.write_snapshot(a, root)
    b = ST.upsert(ST.read_current(spark, root), spark.createDataFrame([(1, "y")], "k long, v string"), "k")
    path = ST.write_snapshot(b, root)
    assert path.endswith("snapshot=1")
    assert [tuple(r) for r in ST.read_current(spark, root).collect()] == [(1, "y")]


def test_contract_and_tables(spark, tmp_dir):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, None), (None, 2, "c")], "g long, p long, name string")
    r = ST.contract_violations(df, ["g", "p"], ["name"]).first()
    assert (r.duplicate_keys, r.null_keys, r.null_name) == (1, 1, 1)
    paths = ST.ensure_tables(spark, tmp_dir)
    assert spark.read.parquet(paths["pro_players"]).count() == 0
    assert "predicted_fpts" in spark.read.parquet(paths["pro_players"]).columns


def test_conform_fills_missing_columns(spark):
    from rinkspark import schemas

    df = spark.createDataFrame([(1, "Bob")], "player_id long, player_name string")
    out = ST.conform(df, schemas.PRO_PLAYERS)
    assert out.columns == [f.name for f in schemas.PRO_PLAYERS.fields]
    assert out.select(F.col("is_goalie")).first()[0] is None


def test_damaged_table_is_never_replaced(spark, tmp_dir):
    paths = ST.ensure_tables(spark, tmp_dir)
    spark.createDataFrame([(1, "a")], "team_id long, team_name string").write.mode("overwrite").parquet(paths["fantasy_team"])
    files = [f for f in glob.glob(f"{paths['fantasy_team']}/part-*.parquet")]
    for f in files:
        with open(f, "r+b") as fh:
            fh.truncate(10)
        if os.path.exists(crc := os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")):
            os.remove(crc)
    ST.ensure_tables(spark, tmp_dir)
    assert sorted(glob.glob(f"{paths['fantasy_team']}/part-*.parquet")) == sorted(files)


def test_unreadable_pointer_is_an_error(spark, tmp_dir):
    root = f"{tmp_dir}/dim"
    assert ST.current_snapshot(spark, root) is None
    ST.write_snapshot(spark.createDataFrame([(1, "x")], "k long, v string"), root)
    assert ST.path_exists(spark, root) and not ST.path_exists(spark, f"{root}/none")
    with pytest.raises(Exception):
        ST.path_exists(spark, "nostore://x/y")


def test_partial_upsert_reduces_repeated_keys(spark):
    old = spark.createDataFrame([(1, 1.0)], "k long, x double")
    new = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 3.0), (2, 2.0)], "k long, x double")
    assert sorted(tuple(r) for r in ST.partial_upsert(old, new, "k", ["x"]).collect()) == [(1, 7.0), (2, 3.0)]


def test_partition_overwrite_leaves_the_session_setting(spark, tmp_dir):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    ST.overwrite_partitions(spark.createDataFrame([(9, "2025")], "id long, season string"), f"{tmp_dir}/p", ["season"])
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
