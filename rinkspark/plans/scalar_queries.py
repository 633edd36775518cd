"""Registered queries for the scalar functions (F1-F17) and nested JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark import functions as RF
from rinkspark.plans import standins as S
from rinkspark.plans.registry import register


from rinkspark.plans.rounding import r4, rnd4  # noqa: E402,F401


# F3 + T12: skater points per line, summed per game -------------------------
@register(
    "weighted_score",
    S.with_ctes(S.SKATER_LINES_SQL)
    + """
SELECT game_id, count(*) AS n_lines, round(sum(total_fpts), 2) AS total_fpts,
       CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(coalesce(blocked_shots, 0)) AS BIGINT) AS blocked_shots
FROM skater_lines GROUP BY game_id""",
)
def weighted_score(spark, d):
    lines = S.skater_lines(spark, d)
    return lines.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.round(F.sum("total_fpts"), 2).alias("total_fpts"),
        F.sum("goals").alias("goals"),
        F.sum(RF.filled("blocked_shots")).alias("blocked_shots"),
    )


# F4 + F5: goalie flags and points --------------------------------------------
@register(
    "flag_score",
    S.with_ctes(S.GOALIE_LINES_SQL)
    + """
SELECT game_id, decision, goals_against, saves, wins, ot_losses, shutouts, total_fpts, round(save_pct, 4) AS save_pct
FROM goalie_lines""",
)
def flag_score(spark, d):
    g = S.goalie_lines(spark, d)
    return g.select(
        "game_id", "decision", "goals_against", "saves", "wins", "ot_losses", "shutouts", "total_fpts", r4("save_pct")
    )


# time on ice text -> seconds ----------------------------------------------
def _toi_text(ts, kind, eid):
    mm = F.minute(ts)
    ss = F.second(ts)
    good = F.format_string("%d:%02d", mm, ss)
    return (
        F.when(kind == "error", F.lit("bad"))
        .when(kind == "signup", F.lit(None).cast("string"))
        .when(kind == "view", F.concat(good, F.lit(":00")))
        .when(kind == "click", F.format_string("%d", mm))
        .otherwise(good)
    )


@register(
    "duration_parse",
    """
WITH t AS (
  SELECT event_id,
         CASE event_type
           WHEN 'error' THEN 'bad'
           WHEN 'signup' THEN NULL
           WHEN 'view' THEN printf('%d:%02d', minute(ts), second(ts)) || ':00'
           WHEN 'click' THEN printf('%d', minute(ts))
           ELSE printf('%d:%02d', minute(ts), second(ts)) END AS toi
  FROM events
)
SELECT event_id, toi,
       CASE WHEN len(string_split(toi, ':')) = 2
                 AND regexp_full_match(trim(string_split(toi, ':')[1]), '[+-]?[0-9]+')
                 AND regexp_full_match(trim(string_split(toi, ':')[2]), '[+-]?[0-9]+')
            THEN CAST(trim(string_split(toi, ':')[1]) AS INTEGER) * 60 + CAST(trim(string_split(toi, ':')[2]) AS INTEGER)
            ELSE 0 END AS toi_seconds
FROM t""",
)
def duration_parse(spark, d):
    e = S.table(spark, d, "events")
    t = e.select("event_id", _toi_text(F.col("ts"), F.col("event_type"), F.col("event_id")).alias("toi"))
    return t.select("event_id", "toi", RF.toi_to_seconds("toi").alias("toi_seconds"))


# ratio or null ----------------------------------------------------------
@register(
    "ratio_or_null",
    """
SELECT l_orderkey, l_linenumber, l_suppkey,
       round(CASE WHEN round(l_tax * 100) = 0 THEN NULL ELSE round(l_discount * 100) / round(l_tax * 100) END, 4) AS ratio
FROM lineitem""",
)
def ratio_or_null(spark, d):
    li = S.table(spark, d, "lineitem")
    ratio = RF.ratio_or_null(F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", rnd4(ratio).alias("ratio"))


# Name key ------------------------------------------------------------
_POSITION_WORDS = "CASE {c} WHEN 'AUTOMOBILE' THEN 'Goalie' WHEN 'BUILDING' THEN 'Center' WHEN 'FURNITURE' THEN 'Defense' WHEN 'HOUSEHOLD' THEN 'Left Wing' ELSE 'Right Wing' END"


def _key_sql(name, pos):
    clean = (
        f"trim(regexp_replace(replace(regexp_replace(replace(lower(coalesce({name}, '')), '-', ' '), "
        f"'([a-z])\\.([a-z])', '\\1. \\2', 'g'), '.', ''), '\\s+', ' ', 'g'))"
    )
    parts = f"string_split({clean}, ' ')"
    form = (
        f"CASE WHEN {clean} = '' THEN '' WHEN len({parts}) < 2 THEN strip_accents({clean}) "
        f"ELSE regexp_replace(substring(strip_accents({parts}[1]), 1, 1) || strip_accents({parts}[-1]), '[\\s\\-]', '', 'g') END"
    )
    return (
        f"CASE WHEN coalesce({name}, '') = '' OR coalesce({pos}, '') = '' THEN '' "
        f"ELSE {form} || '-' || upper(substring({pos}, 1, 1)) END"
    )


# The players once more in another spelling, and what that spelling means: SQL
# keys the plain name.
_SPELLED = ("'Ǆon ' || translate(c_name, 'aeou', 'áèöû') || 'ﬁ한'", "'DZon ' || c_name || 'fi_han_'")


@register(
    "name_key",
    f"""
WITH src AS (
  SELECT c_custkey AS id, 'customer' AS src, c_name AS name, c_name AS plain, {_POSITION_WORDS.format(c='c_mktsegment')} AS position FROM customer
  UNION ALL
  SELECT c_custkey AS id, 'spelled' AS src, {_SPELLED[0]} AS name, {_SPELLED[1]} AS plain, {_POSITION_WORDS.format(c='c_mktsegment')} AS position FROM customer
  UNION ALL
  SELECT p_partkey AS id, 'part' AS src, p_brand || ' ' || p_name AS name, p_brand || ' ' || p_name AS plain, p_type AS position FROM part
)
SELECT id, src, name, position,
       replace({_key_sql('plain', 'position')}, '_han_', chr(4370) || chr(4449) || chr(4523)) AS player_key FROM src""",
)
def name_key(spark, d):
    position = F.expr(_POSITION_WORDS.format(c="c_mktsegment")).alias("position")
    customer = S.table(spark, d, "customer")
    c = customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("src"), F.col("c_name").alias("name"), position)
    v = customer.select(F.col("c_custkey").alias("id"), F.lit("spelled").alias("src"), F.expr(_SPELLED[0]).alias("name"), position)
    p = S.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.lit("part").alias("src"),
        F.concat_ws(" ", "p_brand", "p_name").alias("name"),
        F.col("p_type").alias("position"),
    )
    src = c.unionByName(v).unionByName(p)
    return src.select("id", "src", "name", "position", RF.player_key("name", "position").alias("player_key"))


# S1-S3 + T4: nested JSON ------------------------------------------------------
PROPS = T.StructType([T.StructField("k", T.LongType())])


@register(
    "json_explode",
    """
SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS k2
FROM events""",
)
def json_explode(spark, d):
    e = S.table(spark, d, "events")
    parsed = e.select("event_id", "user_id", F.from_json("props", PROPS).alias("p"))
    return parsed.select("event_id", "user_id", F.col("p.k").alias("k"), (F.col("p.k") * 2).alias("k2"))


# C1-C3 + F8: games by league-zone date --------------------------------------
CAL_AS_OF = "2024-01-20"


@register(
    "games_by_date",
    f"""
WITH g AS (
  SELECT event_id, CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) AS game_date FROM events
)
SELECT game_date, count(*) AS n_games,
       game_date < DATE '{CAL_AS_OF}' AS is_past,
       game_date = DATE '{CAL_AS_OF}' - INTERVAL 1 DAY AS is_yesterday,
       min(event_id) AS first_game_id
FROM g GROUP BY game_date""",
)
def games_by_date(spark, d):
    from rinkspark.operators import calendar as C

    e = S.table(spark, d, "events").select(F.col("event_id").alias("game_id"), F.col("ts").alias("start_time_utc"))
    by_date = C.games_by_date(e).groupBy("game_date").agg(
        F.count(F.lit(1)).alias("n_games"), F.min("game_id").alias("first_game_id")
    )
    as_of = F.lit(CAL_AS_OF).cast("date")
    return by_date.select(
        "game_date",
        "n_games",
        (F.col("game_date") < as_of).alias("is_past"),
        (F.col("game_date") == F.date_sub(as_of, 1)).alias("is_yesterday"),
        "first_game_id",
    )
