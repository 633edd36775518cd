"""Join helpers: broadcast only behind a checked size bound.

Two kinds of check, by where the small side comes from:

* a dimension read from storage (teams, name maps, search terms): a bounded
  count proves it has at most ``max_rows`` rows (the count reads at most
  ``max_rows + 1`` rows), then it is broadcast - :func:`join_small`;
* a side derived by an aggregation (difficulty tables, per-day totals): no
  count, which would compute the aggregate twice. The join is planned as a
  shuffle join and AQE converts it to a broadcast at run time when the
  materialised shuffle output is under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold`` - a size check on the
  actual bytes, with the shuffle join as the way beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimension tables below this many rows are broadcast (teams, weights, a
# search-term list). 100k narrow rows stay far below the broadcast limit.
DEFAULT_MAX_BROADCAST_ROWS = 100_000


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has no more than ``max_rows`` rows (reads at most one
    row more). Asked anew each time: a table may have grown since."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if its row count is proven small, else ``df`` as is."""
    return F.broadcast(df) if has_at_most(df, max_rows) else df


# Rows that one task sorts and aggregates: some 100 bytes each, several times.
ROWS_PER_TASK = 200_000


def partitions_for(df: DataFrame) -> int:
    """Into how many partitions to deal ``df`` (a table read from storage,
    whose files hold their row counts) for ``ROWS_PER_TASK`` rows each. A
    ``repartition`` by number is not merged by AQE, whose target counts
    compressed bytes: a task's memory then stays the same at any size."""
    return max(1, -(-df.count() // ROWS_PER_TASK))


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str] | Column,
    how: str = "inner",
    max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join ``big`` to a dimension that is broadcast when proven small.

    ``small`` must be the build side: inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "semi", "left_anti", "anti"):
        raise ValueError(f"join_small cannot broadcast the right side of a {how} join")
    return big.join(bounded_broadcast(small, max_rows), on, how)
