"""Registered feature and forecast queries (M1-M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkspark.operators import features as M
from rinkspark.plans import standins as S
from rinkspark.plans.ingest_queries import _lines
from rinkspark.plans.registry import ORACLES, register
from rinkspark.streaming.totals import work_root

FOREST_CUTOFF = "2024-01-23"


from rinkspark.plans.rounding import r4, rnd4  # noqa: E402,F401


@register(
    "rolling_features",
    S.with_ctes(S.EVENT_LINES_SQL)
    + """,
w AS (
  SELECT game_id, player_id, game_date, opponent_abbrev,
         avg(total_fpts) OVER (PARTITION BY player_id ORDER BY game_date, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a3,
         avg(total_fpts) OVER (PARTITION BY player_id ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5,
         date_diff('day', lag(game_date) OVER (PARTITION BY player_id ORDER BY game_date, game_id), game_date) AS rest_days,
         row_number() OVER (PARTITION BY player_id ORDER BY game_date, game_id) AS game_number
  FROM event_lines
),
d AS (SELECT opponent_abbrev, game_date, sum(total_fpts) AS s, count(total_fpts) AS n FROM event_lines GROUP BY opponent_abbrev, game_date),
o AS (
  SELECT opponent_abbrev, game_date,
         sum(s) OVER (PARTITION BY opponent_abbrev ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         / sum(n) OVER (PARTITION BY opponent_abbrev ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opp
  FROM d
)
SELECT w.game_id, w.player_id, w.game_date, round(w.a3, 4) + 0.0 AS avg_prev_3, round(w.a5, 4) + 0.0 AS avg_prev_5,
       CAST(w.rest_days AS INTEGER) AS rest_days, w.rest_days = 1 AS back_to_back, w.game_number,
       round(o.opp, 4) + 0.0 AS opp_strength
FROM w JOIN o ON o.opponent_abbrev = w.opponent_abbrev AND o.game_date = w.game_date""",
)
def rolling_features(spark, d):
    ev = S.event_lines(spark, d).select("game_id", "player_id", "game_date", "opponent_abbrev", "total_fpts")
    out = M.opponent_strength(M.rolling_features(ev))
    return out.select(
        "game_id", "player_id", "game_date", r4("avg_prev_3"), r4("avg_prev_5"), "rest_days", "back_to_back",
        "game_number", r4("opp_strength"),
    )


@register("rolling_features_large", ORACLES["rolling_features"])
def rolling_features_large(spark, d):
    """The same features by the plan for hot players, on every player."""
    ev = S.event_lines(spark, d).select("game_id", "player_id", "game_date", "opponent_abbrev", "total_fpts")
    out = M.opponent_strength(M.rolling_features(ev, max_group_rows=0))
    return out.select(
        "game_id", "player_id", "game_date", r4("avg_prev_3"), r4("avg_prev_5"), "rest_days", "back_to_back",
        "game_number", r4("opp_strength"),
    )


@register(
    "home_away_split",
    S.with_ctes(S.GAMES_SQL)
    + """,
lines AS (
  SELECT l.l_orderkey AS game_id, o.o_custkey AS player_id, n.n_name AS team_abbrev, l.l_quantity AS total_fpts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
)
SELECT l.player_id, count_if(l.team_abbrev = g.home_abbrev) AS home_games, count_if(l.team_abbrev <> g.home_abbrev) AS away_games,
       round(avg(CASE WHEN l.team_abbrev = g.home_abbrev THEN l.total_fpts END), 4) AS avg_home,
       round(avg(CASE WHEN l.team_abbrev <> g.home_abbrev THEN l.total_fpts END), 4) AS avg_away
FROM lines l JOIN games g ON g.game_id = l.game_id
GROUP BY l.player_id""",
)
def home_away_split(spark, d):
    nat = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("team_abbrev"))
    # The line's order brings the player too: orders are read once for the
    # lines and once for the games' home side.
    lines = S.join_small(_lines(spark, d, "o_custkey"), nat, "s_nationkey", "inner", S.NATION_ROWS_MAX)
    fact = lines.select(
        F.col("l_orderkey").alias("game_id"),
        F.col("o_custkey").alias("player_id"),
        "team_abbrev",
        F.col("l_quantity").alias("total_fpts"),
    )
    out = M.home_away_split(fact, S.games(spark, d))
    return out.select("player_id", "home_games", "away_games", r4("avg_home"), r4("avg_away"))


def forecast_lines(spark, d):
    """Event lines with the mean of the previous three games as a forecast
    (first games have none and are left out)."""
    ev = S.event_lines(spark, d).select("game_id", "player_id", "game_date", "opponent_abbrev", "total_fpts")
    return M.rolling_features(ev).where(F.col("avg_prev_3").isNotNull()).withColumn("prediction", F.col("avg_prev_3"))


_FORECAST_SQL = (
    S.with_ctes(S.EVENT_LINES_SQL, S.PLAYERS_SQL)
    + """,
f AS (
  SELECT * FROM (
    SELECT game_id, player_id, game_date, total_fpts,
           avg(total_fpts) OVER (PARTITION BY player_id ORDER BY game_date, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prediction
    FROM event_lines)
  WHERE prediction IS NOT NULL
)
"""
)


@register(
    "forecast_metrics",
    _FORECAST_SQL
    + """SELECT round(avg(abs(prediction - total_fpts)), 4) AS mae,
       round(1 - sum((prediction - total_fpts) * (prediction - total_fpts)) / (var_pop(total_fpts) * count(*)), 4) AS r2
FROM f""",
)
def forecast_metrics(spark, d):
    """M6 on a forecast that SQL can state."""
    return M.evaluate(forecast_lines(spark, d)).select(r4("mae"), r4("r2"))


@register(
    "forecast_dimension",
    _FORECAST_SQL
    + """, last AS (
  SELECT player_id, prediction FROM (
    SELECT player_id, prediction, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS rn FROM f)
  WHERE rn = 1
)
SELECT coalesce(p.player_id, l.player_id) AS player_id, p.player_name, round(l.prediction, 4) AS predicted_fpts
FROM players p FULL JOIN last l ON l.player_id = p.player_id""",
)
def forecast_dimension(spark, d):
    """M7 on the same forecast: the latest one per player, upserted."""
    dim = S.players(spark, d).select("player_id", "player_name", F.lit(None).cast("double").alias("predicted_fpts"))
    out = M.predictions_to_dimension(dim, forecast_lines(spark, d))
    return out.select("player_id", "player_name", r4("predicted_fpts"))


def _fitted(spark, d):
    """The forest trained on event lines before the cutoff date, and the lines
    from the cutoff on."""
    ev = S.event_lines(spark, d).select("game_id", "player_id", "game_date", "opponent_abbrev", "total_fpts")
    frame = M.model_frame(ev)
    train, test = M.split_by_date(frame, FOREST_CUTOFF)
    # The forest makes several passes over the training rows: keep them
    # (recomputed from lineage if an executor is lost).
    train = train.persist()
    model = M.train_forest(train)
    train.unpersist()
    return model, test


@register("forest_predict")
def forest_predict(spark, d):
    """M5-M7 (rows-only check): predictions of the forest for every line from
    the cutoff on."""
    model, test = _fitted(spark, d)
    pred = model.transform(test)
    return pred.select("game_id", "player_id", "game_date", "total_fpts", F.round("prediction", 4).alias("prediction"))


@register(
    "forest_expression",
    f"""
SELECT CAST(ts AS DATE) AS game_date, count(*) AS n_lines, CAST(0 AS BIGINT) AS n_different
FROM events WHERE CAST(ts AS DATE) >= DATE '{FOREST_CUTOFF}' GROUP BY 1""",
)
def forest_expression(spark, d):
    """M5: the forest as a node table and a column expression, against the
    model itself on every line from the cutoff on: lines per day, and those
    with another prediction (none)."""
    model, test = _fitted(spark, d)
    same = M.forest_column(model, M.forest_nodes(model, work_root(spark, "forest")))
    both = model.transform(test.withColumn("_expression", same))
    return both.groupBy("game_date").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("_expression").eqNullSafe(F.col("prediction"))).alias("n_different")
    )


@register("forest_metrics")
def forest_metrics(spark, d):
    """M6 (rows-only check): MAE and R2 of the forecast on the test days."""
    pred = forest_predict(spark, d)
    return M.evaluate(pred)


@register("forest_dimension")
def forest_dimension(spark, d):
    """M7 (rows-only check): each player's latest forecast written into the
    player dimension's ``predicted_fpts`` (partial upsert: other columns and
    players without a forecast untouched)."""
    dim = S.players(spark, d).select(
        "player_id", "player_name", "team_abbrev", "fantasy_team_id", F.lit(None).cast("double").alias("predicted_fpts")
    )
    pred = forest_predict(spark, d)
    return M.predictions_to_dimension(dim, pred)
