"""Scalar functions against the hand-computed fixture rows (FIXTURES.md 5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rinkspark import functions as RF
from rinkspark.operators import analysis as A


def one(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_skater_points(spark):
    rows = [(1, 2, 1, 0, 4, 1, 3)]
    schema = "goals int, assists int, pp_points int, sh_points int, shots int, blocked_shots int, hits int"
    assert one(spark, schema, rows, RF.skater_points()) == [5.7]


def test_skater_points_nulls_count_as_zero(spark):
    schema = "goals int, assists int, pp_points int, sh_points int, shots int, blocked_shots int, hits int"
    assert one(spark, schema, [(1, None, None, None, None, None, None)], RF.skater_points()) == [2.0]


@pytest.mark.parametrize(
    "decision,ga,saves,points,shutout",
    [("W", 0, 30, 13.0, 1), ("O", 3, 25, 0.0, 0), (None, 0, 0, 0.0, 0), (None, None, 10, 2.0, 0)],
)
def test_goalie_points(spark, decision, ga, saves, points, shutout):
    schema = "decision string, goals_against int, saves int"
    df = spark.createDataFrame([(decision, ga, saves)], schema)
    r = df.select(RF.goalie_points().alias("p"), RF.shutout_flag().alias("s")).first()
    assert (r.p, r.s) == (points, shutout)


def test_ratio_or_null(spark):
    assert one(spark, "g int, s int", [(1, 0), (1, 4), (None, 2)], RF.ratio_or_null("g", "s")) == [None, 0.25, None]


def test_toi_to_seconds(spark):
    rows = [("12:34",), ("00:00",), ("bad",), (None,), ("1:2:3",), ("5",), ("1.5:10",), (" 2:05",)]
    assert one(spark, "t string", rows, RF.toi_to_seconds("t")) == [754, 0, 0, 0, 0, 0, 0, 125]


@pytest.mark.parametrize(
    "instant,local,key",
    [
        ("2025-11-10T00:30:00Z", dt.date(2025, 11, 9), "2025-W45"),
        ("2024-12-30T05:00:00Z", dt.date(2024, 12, 30), "2025-W01"),
        ("2024-12-30T04:00:00Z", dt.date(2024, 12, 29), "2024-W52"),
        ("2027-01-03T20:00:00Z", dt.date(2027, 1, 3), "2026-W53"),
        ("2025-03-10T03:30:00Z", dt.date(2025, 3, 9), "2025-W10"),
    ],
)
def test_league_date_and_week_key(spark, instant, local, key):
    df = spark.createDataFrame([(instant,)], "s string").select(RF.parse_instant("s").alias("ts"))
    r = df.select(RF.league_date("ts").alias("d"), RF.week_key("ts").alias("k")).first()
    assert (r.d, r.k) == (local, key)


def test_unparsable_instant_is_null(spark):
    assert one(spark, "s string", [("not a date",)], RF.parse_instant("s")) == [None]


def test_week_bounds(spark):
    df = spark.createDataFrame([("2026-W53",), ("2025-W01",), ("2025-W45",)], "k string")
    mon, sun = RF.week_bounds_of_key("k")
    got = [(r.m, r.s) for r in df.select(mon.alias("m"), sun.alias("s")).collect()]
    assert got == [
        (dt.date(2026, 12, 28), dt.date(2027, 1, 3)),
        (dt.date(2024, 12, 30), dt.date(2025, 1, 5)),
        (dt.date(2025, 11, 3), dt.date(2025, 11, 9)),
    ]


def test_matchup_text_and_parse(spark):
    df = spark.createDataFrame([(True, "WSH", dt.date(2025, 11, 17)), (False, "BOS", None)], "h boolean, o string, d date")
    assert [r[0] for r in df.select(RF.matchup_text("h", "o")).collect()] == ["vs WSH", "@ BOS"]
    assert df.select(RF.matchup_text("h", "o", "d")).first()[0] == "vs WSH (2025-11-17)"
    s = spark.createDataFrame([("@ DAL, vs WPG",)], "x string")
    items = s.select(F.explode(RF.matchup_items("x")).alias("i")).select(RF.matchup_code("i")).collect()
    assert [r[0] for r in items] == ["DAL", "WPG"]


def test_average_rank_cut(spark):
    vals = [3.0, 2.0, 2.0, 2.0, 1.0, 0.5, 0.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r.rank for r in A.average_rank(df, "v").orderBy("i").collect()]
    assert got == [1, 3, 3, 3, 5, 6, 6]


def test_tiers(spark):
    df = spark.createDataFrame([(10,), (11,), (22,), (23,)], "rank int")
    assert [r[0] for r in df.select(A.difficulty_tier("rank")).collect()] == ["Easy", "Average", "Average", "Hard"]


def test_label_or(spark):
    assert one(spark, "t string", [(None,), ("Kings",)], RF.label_or("t")) == ["*** Free Agent ***", "Kings"]


def test_seconds_to_minutes(spark):
    assert one(spark, "s int", [(90,)], RF.seconds_to_minutes("s")) == [1.5]


def test_toi_beyond_an_int_is_zero(spark):
    from rinkspark.functions.scoring import toi_to_seconds

    df = spark.createDataFrame([("99999999:00",), ("35791394:07",), ("35791394:08",)], "toi string")
    assert [r[0] for r in df.select(toi_to_seconds("toi")).collect()] == [0, 2147483647, 0]
