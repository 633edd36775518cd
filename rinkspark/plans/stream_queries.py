"""Registered streaming query (X1-X3): events landed by day, streamed in
several micro-batches, totals kept by touched-key recompute. The result
must equal the batch totals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.plans import standins as S
from rinkspark.plans.registry import register
from rinkspark.streaming.totals import corrected, final_totals, land_by_day, run_corrections, run_incremental_totals, work_root


@register(
    "stream_totals",
    """
SELECT user_id AS player_id, count(*) AS games, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) AS total_points
FROM events GROUP BY user_id""",
)
def stream_totals(spark, d):
    root = work_root(spark, "stream-totals")
    ev = S.table(spark, d, "events").select(
        F.col("event_id").alias("game_id"), F.col("user_id").alias("player_id"), "ts", F.col("value").alias("total_fpts")
    )
    landing = land_by_day(ev, f"{root}/landing", "ts")
    schema = T.StructType(ev.schema.fields + [T.StructField("landed_day", T.DateType())])
    run_incremental_totals(spark, landing, schema, root=root, max_files_per_trigger=16)
    out = final_totals(spark, root)
    return out.select("player_id", "games", F.col("total_points").cast("double").alias("total_points"))


@register(
    "stream_corrections",
    """
SELECT event_id AS game_id, user_id AS player_id, CAST(value AS DOUBLE) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS points,
       CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS landing
FROM events""",
)
def stream_corrections(spark, d):
    """X1 and X3 with a state store: all events land, then a third again with
    other points, twice; then older landings of all of them, in micro-batches
    of their own. The delay spans the table, so none is too late."""
    root = work_root(spark, "stream-corrections")
    ev = S.table(spark, d, "events").select(
        F.col("event_id").alias("game_id"), F.col("user_id").alias("player_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("points")
    )

    def landing(rows, number):
        return rows.withColumn("landed_at", F.timestamp_seconds(F.lit(number))).withColumn("landing", F.lit(number))

    third = landing(ev.where(F.col("game_id") % 3 == 0).withColumn("points", F.col("points") + 1), 3)
    older = landing(ev.withColumn("points", F.lit(-1.0)), 1)
    schema = older.schema
    for rows in (landing(ev, 2), third.unionAll(third), older):
        rows.write.mode("append").parquet(f"{root}/landing")
        run_corrections(spark, f"{root}/landing", schema, root, delay="3650 days", max_files_per_trigger=64)
    return corrected(spark, root, schema).select("game_id", "player_id", "points", "landing")
