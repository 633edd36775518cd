"""Features and forecast helpers (M1-M7) on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from rinkspark.operators import calendar as C
from rinkspark.operators import features as M

D = dt.date


def test_rest_days_and_first_game(spark):
    df = spark.createDataFrame(
        [(1, 7, D(2025, 1, 1), "A", 1.0), (2, 7, D(2025, 1, 2), "B", 3.0), (3, 7, D(2025, 1, 5), "A", 5.0)],
        "game_id long, player_id long, game_date date, opponent_abbrev string, total_fpts double",
    )
    rows = {r.game_id: r for r in M.opponent_strength(M.rolling_features(df)).collect()}
    assert rows[1].avg_prev_3 is None and rows[1].rest_days is None and rows[1].opp_strength is None
    assert (rows[2].avg_prev_3, rows[2].rest_days, rows[2].back_to_back) == (1.0, 1, True)
    assert (rows[3].avg_prev_3, rows[3].avg_prev_5, rows[3].rest_days) == (2.0, 2.0, 3)
    assert rows[3].opp_strength == 1.0  # opponent A allowed 1.0 before 2025-01-05


def test_home_away_split(spark):
    fact = spark.createDataFrame([(1, 7, "BOS", 2.0), (2, 7, "BOS", 4.0)], "game_id long, player_id long, team_abbrev string, total_fpts double")
    games = spark.createDataFrame([(1, "BOS"), (2, "TOR")], "game_id long, home_abbrev string")
    r = M.home_away_split(fact, games).first()
    assert (r.home_games, r.away_games, r.avg_home, r.avg_away) == (1, 1, 2.0, 4.0)


def test_evaluate_and_write_predictions(spark):
    pred = spark.createDataFrame(
        [(1, 7, D(2025, 1, 1), 2.0, 1.0), (2, 7, D(2025, 1, 2), 4.0, 5.0), (3, 8, D(2025, 1, 2), 6.0, 6.0)],
        "game_id long, player_id long, game_date date, total_fpts double, prediction double",
    )
    m = M.evaluate(pred).first()
    assert abs(m.mae - 2 / 3) < 1e-12
    assert abs(m.r2 - (1 - 2 / 8)) < 1e-12  # SSE 2, variance 8/3 over 3 rows
    dim = spark.createDataFrame([(7, "A", None), (9, "C", 1.5)], "player_id long, player_name string, predicted_fpts double")
    out = {r.player_id: r.predicted_fpts for r in M.predictions_to_dimension(dim, pred).collect()}
    assert out == {7: 5.0, 8: 6.0, 9: 1.5}  # latest prediction per player; others untouched


def test_league_teams_zero_fill(spark):
    teams = C.league_teams(spark)
    assert teams.count() == 32
    out = C.remaining_games(
        spark.createDataFrame([], "game_id long, start_time_utc timestamp, game_date date, home_abbrev string, away_abbrev string"),
        "2025-11-12",
        teams,
    )
    assert out.where("n_games = 0").count() == 32


def test_forest_as_nodes_and_expression(spark, tmp_dir):
    """Predictions of the column expression equal the model's, bit for bit,
    with kinds the training rows do not hold and a null kind."""
    rows = [(i, i % 9, D(2025, 1, 1) + dt.timedelta(days=i % 40), "ABCDE"[i % 5], float((i * 37) % 23) + i % 5) for i in range(600)]
    schema = "game_id long, player_id long, game_date date, opponent_abbrev string, total_fpts double"
    frame = M.model_frame(spark.createDataFrame(rows, schema)).persist()
    model = M.train_forest(frame, trees=5)
    nodes = M.forest_nodes(model, f"{tmp_dir}/forest")
    leaf = nodes.where("left < 0")
    assert nodes.select("tree").distinct().count() == 5
    assert leaf.where("feature is not null or threshold is not null or kinds is not null").count() == 0
    assert nodes.where("left >= 0 and (threshold is null) = (kinds is null)").count() == 0
    new = frame.withColumn("f_kind", F.when(F.col("game_id") % 7 == 0, F.lit("Z")).when(F.col("game_id") % 11 == 0, F.lit(None)).otherwise(F.col("f_kind")))
    out = model.transform(new.withColumn("e", M.forest_column(model, nodes)))
    assert out.where("not e <=> prediction").count() == 0
    assert out.select("e").distinct().count() > 5
    frame.unpersist()
