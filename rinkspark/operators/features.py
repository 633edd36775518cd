"""Model features and the point forecast (M1-M7).

Rolling means over the previous k games (M1) and days of rest (M2) use one
window per player when the largest player is small enough for one task.
When a player is hot (a third of all games, say), that window would put
all of them into one task, so the skew-safe plan is used instead:

1. rows are range-partitioned by (player, date, game), which cuts a hot
   player, and a hot day of one player, into ranges of about equal size;
2. a window within (player, range) numbers the games, and a window over one
   row per (player, range) adds the games of the ranges before: the index;
3. each game forwards its value and date to the games ``i+1 .. i+k``; one
   aggregation on (player, index) - a key with at most ``max(ks)`` rows -
   averages what each game received.

Both plans average the same values: nulls do not count, a null date sorts
first, and no value is rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rinkspark.session import cut_lineage


def game_index(
    df: DataFrame,
    *,
    key: str = "player_id",
    date_col: str = "game_date",
    order_col: str = "game_id",
) -> DataFrame:
    """Adds ``_i``, the 1-based position of the game in the player's history
    (by date, nulls first, then ``order_col``), without a per-player window.

    The ranges are fixed by a reliable checkpoint, so that a lost task sees
    the same ones again."""
    ranged = cut_lineage(df.repartitionByRange(key, date_col, order_col).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(key, "_range").orderBy(date_col, order_col)
    local = ranged.withColumn("_n", F.row_number().over(inside))
    sizes = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    out = local.join(offsets, local[key].eqNullSafe(offsets["_k"]) & (local["_range"] == offsets["_r"]), "inner")
    return out.select(*[local[c] for c in df.columns], (F.col("_off") + F.col("_n")).alias("_i"))


# A window partition of up to this many rows is cheap for one task.
MAX_WINDOW_GROUP_ROWS = 1_000_000


def largest_group(df: DataFrame, key: str) -> int:
    """Rows of the largest ``key`` group (a partial aggregation, then one
    scalar to the driver)."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return int(n or 0)


def rolling_features(
    df: DataFrame,
    ks: Sequence[int] = (3, 5),
    *,
    key: str = "player_id",
    date_col: str = "game_date",
    order_col: str = "game_id",
    value: str = "total_fpts",
    max_group_rows: int = MAX_WINDOW_GROUP_ROWS,
) -> DataFrame:
    """M1 + M2: mean of ``value`` over the previous k games for each k (the
    current game excluded; null for a first game), days since the previous
    game (null for a first game), a back-to-back flag and the game number.

    When no player has more than ``max_group_rows`` games, one window per
    player is cheapest (one shuffle). Beyond that bound a hot player would
    sit in one task, so the skew-safe plan by ranges is used instead; both give
    the same columns and values."""
    if largest_group(df, key) <= max_group_rows:
        return _rolling_by_window(df, ks, key=key, date_col=date_col, order_col=order_col, value=value)
    return _rolling_by_ranges(df, ks, key=key, date_col=date_col, order_col=order_col, value=value)


def _rolling_by_window(df, ks, *, key, date_col, order_col, value) -> DataFrame:
    w = Window.partitionBy(key).orderBy(date_col, order_col)
    cols = [F.col(c) for c in df.columns]
    for k in ks:
        cols.append(F.avg(value).over(w.rowsBetween(-k, -1)).alias(f"avg_prev_{k}"))
    rest = F.datediff(F.col(date_col), F.lag(date_col).over(w))
    cols += [rest.alias("rest_days"), (rest == 1).alias("back_to_back"), F.row_number().over(w).cast("bigint").alias("game_number")]
    return df.select(*cols)


def _rolling_by_ranges(df, ks, *, key, date_col, order_col, value) -> DataFrame:
    idx = game_index(df, key=key, date_col=date_col, order_col=order_col)
    steps = F.explode(F.sequence(F.lit(1), F.lit(max(ks))))
    sent = idx.select(F.col(key).alias("_k"), F.col("_i").alias("_from"), F.col(value).alias("_v"), F.col(date_col).alias("_d"), steps.alias("_step"))
    sent = sent.select("_k", (F.col("_from") + F.col("_step")).alias("_t"), "_step", "_v", "_d")
    got = sent.groupBy("_k", "_t").agg(
        *[F.avg(F.when(F.col("_step") <= k, F.col("_v"))).alias(f"avg_prev_{k}") for k in ks],
        F.max(F.when(F.col("_step") == 1, F.col("_d"))).alias("_prev_date"),
    )
    j = idx.join(got, idx[key].eqNullSafe(got["_k"]) & (idx["_i"] == got["_t"]), "left")
    rest = F.datediff(F.col(date_col), F.col("_prev_date"))
    cols = [idx[c] for c in df.columns] + [F.col(f"avg_prev_{k}") for k in ks]
    cols += [rest.alias("rest_days"), (rest == 1).alias("back_to_back"), F.col("_i").cast("bigint").alias("game_number")]
    return j.select(*cols)


def opponent_strength(
    df: DataFrame,
    *,
    opponent: str = "opponent_abbrev",
    date_col: str = "game_date",
    value: str = "total_fpts",
) -> DataFrame:
    """M3: for each line, the mean points the opponent allowed in games
    strictly before this date (null when there is no earlier game).

    Aggregated to one row per (opponent, day) first; the running totals are
    a window over that small table, joined back (AQE broadcasts it at run
    time when its materialised size is small)."""
    day = df.groupBy(opponent, date_col).agg(
        F.count(F.col(value)).alias("_n"), F.sum(F.col(value).cast("double")).alias("_s")
    )
    w = Window.partitionBy(opponent).orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)
    prior = day.select(
        opponent,
        date_col,
        (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("opp_strength"),
    )
    return df.join(prior, [opponent, date_col], "left")


def home_away_split(
    fact: DataFrame,
    games: DataFrame,
    *,
    key: str = "player_id",
    team: str = "team_abbrev",
    value: str = "total_fpts",
) -> DataFrame:
    """M4: per player, games and mean points at home and away; home when the
    line's team equals the game's home code."""
    j = fact.join(games.select("game_id", "home_abbrev"), "game_id", "inner")
    home = F.col(team) == F.col("home_abbrev")
    return j.groupBy(key).agg(
        F.count_if(home).alias("home_games"),
        F.count_if(~home).alias("away_games"),
        F.avg(F.when(home, F.col(value))).alias("avg_home"),
        F.avg(F.when(~home, F.col(value))).alias("avg_away"),
    )


# ---------------------------------------------------------------- M5-M7
def model_frame(df: DataFrame, *, kind_col: str = "opponent_abbrev") -> DataFrame:
    """M1-M4 features with nulls filled (first games: -1), plus a kind index
    (string indexer, fitted inside the pipeline)."""
    feats = opponent_strength(rolling_features(df))
    return feats.select(
        "*",
        F.coalesce("avg_prev_3", F.lit(-1.0)).alias("f_prev3"),
        F.coalesce("avg_prev_5", F.lit(-1.0)).alias("f_prev5"),
        F.coalesce(F.col("rest_days").cast("double"), F.lit(-1.0)).alias("f_rest"),
        F.coalesce(F.col("back_to_back").cast("double"), F.lit(0.0)).alias("f_b2b"),
        F.coalesce("opp_strength", F.lit(-1.0)).alias("f_opp"),
        F.col(kind_col).alias("f_kind"),
    )


def train_forest(train: DataFrame, *, label: str = "total_fpts", trees: int = 20, seed: int = 7):
    """M5: random forest on the features, as a ``pyspark.ml`` pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    idx = StringIndexer(inputCol="f_kind", outputCol="f_kind_ix", handleInvalid="keep")
    vec = VectorAssembler(inputCols=list(FOREST_FEATURES), outputCol="features")
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=6, seed=seed)
    return Pipeline(stages=[idx, vec, rf]).fit(train)


FOREST_FEATURES = ("f_prev3", "f_prev5", "f_rest", "f_b2b", "f_opp", "f_kind_ix")


def forest_nodes(model, path: str) -> DataFrame:
    """M5 as a table: one row per node of the fitted forest, in a fresh folder
    ``path`` of the shared store (the model is saved there).

    Columns: tree, node, prediction, rows (training rows that reached it),
    left, right (-1 at a leaf), feature (name; null at a leaf), threshold (goes
    left at or below it; null for a split by kind), kinds (index values that go
    left; null for a threshold)."""
    forest = model.stages[-1]
    forest.write().overwrite().save(path)
    spark = SparkSession.active()
    n, split = "nodeData", F.col("nodeData.split")
    inner = F.col(f"{n}.leftChild") >= 0
    by_kind = split["numCategories"] >= 0
    names = F.array(*[F.lit(f) for f in FOREST_FEATURES])
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col(f"{n}.id").alias("node"),
        F.col(f"{n}.prediction").alias("prediction"),
        F.col(f"{n}.rawCount").alias("rows"),
        F.col(f"{n}.leftChild").alias("left"),
        F.col(f"{n}.rightChild").alias("right"),
        F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
        F.when(inner & ~by_kind, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner & by_kind, split["leftCategoriesOrThreshold"]).alias("kinds"),
    )


def forest_column(model, nodes: DataFrame) -> Column:
    """M5 as one column expression over the columns of :func:`model_frame`:
    every tree is walked from its root through the node table, held as literal
    arrays, and the leaves are averaged over the trees in order. Scoring is an
    ordinary projection, without a model object or vectors; its size does not
    grow into conditions that generated code could not hold.

    The nodes come to the driver: trees x 2^(depth + 1) rows at most (2,540 for
    20 trees of depth 6), whatever the data. A kind that the indexer has not
    seen, or null, takes the index after the last one, as in the model."""
    rows = sorted(nodes.collect(), key=lambda r: (r.tree, r.node))
    at = {(r.tree, r.node): i for i, r in enumerate(rows)}
    roots = [i for i, r in enumerate(rows) if r.node == 0]

    def array(values) -> Column:
        return F.expr(f"array({', '.join(values)})")

    def doubles(values) -> str:
        return f"cast(array({', '.join(f'{v!r}D' for v in values)}) AS array<double>)"

    left = array(str(at.get((r.tree, r.left), -1)) for r in rows)
    right = array(str(at.get((r.tree, r.right), -1)) for r in rows)
    feature = array(str(FOREST_FEATURES.index(r.feature) if r.feature else -1) for r in rows)
    threshold = F.expr(doubles(0.0 if r.threshold is None else r.threshold for r in rows))
    by_kind = array(str(r.kinds is not None).lower() for r in rows)
    kinds = array(doubles(r.kinds or ()) for r in rows)
    leaf = F.expr(doubles(r.prediction for r in rows))

    labels = model.stages[0].labels
    place = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("f_kind"))
    kind = F.when(place > 0, (place - 1).cast("double")).otherwise(F.lit(float(len(labels))))
    row = F.array(*[F.col(c) for c in FOREST_FEATURES[:-1]], kind)

    def step(i: Column, _: Column) -> Column:
        value = F.get(row, F.get(feature, i))
        goes_left = F.when(F.get(by_kind, i), F.array_contains(F.get(kinds, i), value)).otherwise(value <= F.get(threshold, i))
        return F.when(F.get(left, i) < 0, i).when(goes_left, F.get(left, i)).otherwise(F.get(right, i))

    levels = F.sequence(F.lit(1), F.lit(model.stages[-1].getMaxDepth()))
    total = F.aggregate(array(map(str, roots)), F.lit(0.0), lambda s, root: s + F.get(leaf, F.aggregate(levels, root, step)))
    return total / F.lit(float(len(roots)))


def split_by_date(df: DataFrame, cutoff, *, date_col: str = "game_date") -> tuple[DataFrame, DataFrame]:
    """Train on games before ``cutoff``, test on the rest (no look-ahead)."""
    c = F.lit(str(cutoff)).cast("date")
    return df.where(F.col(date_col) < c), df.where(F.col(date_col) >= c)


def evaluate(pred: DataFrame, *, label: str = "total_fpts") -> DataFrame:
    """M6: MAE and R2 in one aggregation (no driver-side loop)."""
    err = F.col("prediction") - F.col(label)
    stats = pred.agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("_sse"),
        F.var_pop(label).alias("_var"),
        F.count(F.lit(1)).alias("_n"),
    )
    return stats.select("mae", (F.lit(1.0) - F.col("_sse") / (F.col("_var") * F.col("_n"))).alias("r2"))


def predictions_to_dimension(dim: DataFrame, pred: DataFrame, *, key: str = "player_id") -> DataFrame:
    """M7: the latest prediction per player written to ``predicted_fpts``
    (partial upsert: other columns untouched)."""
    from rinkspark.sources.store import partial_upsert

    latest = pred.groupBy(key).agg(
        F.max(F.struct("game_date", "game_id", "prediction")).alias("_p")
    ).select(key, F.col("_p.prediction").alias("predicted_fpts"))
    return partial_upsert(dim, latest, key, ["predicted_fpts"])
