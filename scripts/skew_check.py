"""Time the skew-sensitive operators on the events table and on a skewed
copy of it in which one user holds a third of all rows (every event whose id
is a multiple of 3 is reassigned to user 0). Prints one JSON line.

Usage: python scripts/skew_check.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rinkspark.operators import analysis as A  # noqa: E402
from rinkspark.operators import dimension as D  # noqa: E402
from rinkspark.operators import features as M  # noqa: E402
from rinkspark.plans import standins as S  # noqa: E402
from rinkspark.session import build_session  # noqa: E402


def run(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("skew-check", cpus=8, shuffle_partitions=16)
    ev = S.event_lines(spark, sf).select("game_id", "player_id", "game_date", "season", "opponent_abbrev", "total_fpts")
    hot = ev.withColumn("player_id", F.when(F.col("game_id") % 3 == 0, F.lit(0)).otherwise(F.col("player_id")))
    players = S.players(spark, sf)
    teams = S.fantasy_teams(spark, sf)
    ops = {
        "rolling_features": lambda f: M.rolling_features(f),
        "latest_info": lambda f: D.latest_info(f.withColumn("team_abbrev", F.col("opponent_abbrev"))),
        "season_totals": lambda f: D.skater_season_totals(f),
        "hot_list": lambda f: A.hot_list(f, players, teams, "2024-01-31"),
        "history_vs_opponent": lambda f: A.history_vs_opponent(f),
        # For comparison only (not used by the library): the per-player window
        # that puts a hot player's whole history into one task.
        "naive_player_window": lambda f: f.withColumn(
            "avg_prev_3",
            F.avg("total_fpts").over(
                Window.partitionBy("player_id").orderBy("game_date", "game_id").rowsBetween(-3, -1)
            ),
        ),
    }
    run(ev.limit(1))  # warm-up
    out = {"sf": sf, "hot_share": round(hot.where("player_id = 0").count() / ev.count(), 3), "even": {}, "skewed": {}}
    for name, op in ops.items():
        run(op(ev))  # warm-up of this plan shape
        out["even"][name] = run(op(ev))
        out["skewed"][name] = run(op(hot))
    print(json.dumps(out))


if __name__ == "__main__":
    main()
