"""Scoring and per-line scalar functions (column expressions, JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rinkspark import constants as K

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: ColumnLike, default: float | int = 0) -> Column:
    """Null -> default (T12 default filling)."""
    return F.coalesce(_col(c), F.lit(default))


def weighted_score(
    weights: Mapping[str, float] | Iterable[tuple[ColumnLike, float]], ndigits: int | None = 2
) -> Column:
    """Linear score: sum of weight * measure, nulls count as 0, rounded.

    ``weights`` maps a column name to its weight, or lists (column, weight)
    pairs; the same operator scores skater lines, goalie lines or any
    measure table.
    """
    pairs = weights.items() if isinstance(weights, Mapping) else weights
    terms = [filled(c).cast("double") * F.lit(float(w)) for c, w in pairs]
    if not terms:
        raise ValueError("weighted_score needs at least one weight")
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.round(total, ndigits) if ndigits is not None else total


def skater_points(
    goals: ColumnLike = "goals",
    assists: ColumnLike = "assists",
    pp_points: ColumnLike = "pp_points",
    sh_points: ColumnLike = "sh_points",
    shots: ColumnLike = "shots",
    blocked_shots: ColumnLike = "blocked_shots",
    hits: ColumnLike = "hits",
    weights: Mapping[str, float] = K.SKATER_WEIGHTS,
) -> Column:
    """skater fantasy points, rounded to 2 places."""
    cols = dict(
        goals=goals,
        assists=assists,
        pp_points=pp_points,
        sh_points=sh_points,
        shots=shots,
        blocked_shots=blocked_shots,
        hits=hits,
    )
    return weighted_score([(cols[k], w) for k, w in weights.items()])


def win_flag(decision: ColumnLike = "decision") -> Column:
    """1 when the decision is a win, else 0 (null decision -> 0)."""
    return F.when(_col(decision) == K.WIN_DECISION, 1).otherwise(0)


def ot_loss_flag(decision: ColumnLike = "decision") -> Column:
    """1 when the decision is an overtime loss, else 0."""
    return F.when(_col(decision) == K.OT_LOSS_DECISION, 1).otherwise(0)


def shutout_flag(goals_against: ColumnLike = "goals_against", saves: ColumnLike = "saves") -> Column:
    """shutout needs goals against *equal to* 0 (null is not 0) and saves > 0."""
    ga, sv = _col(goals_against), _col(saves)
    return F.when((ga == 0) & (F.coalesce(sv, F.lit(0)) > 0), 1).otherwise(0)


def goalie_points(
    decision: ColumnLike = "decision",
    goals_against: ColumnLike = "goals_against",
    saves: ColumnLike = "saves",
    weights: Mapping[str, float] = K.GOALIE_WEIGHTS,
) -> Column:
    """goalie fantasy points over the F5 flags, nulls as 0, rounded to 2."""
    parts = {
        "wins": win_flag(decision),
        "goals_against": _col(goals_against),
        "saves": _col(saves),
        "shutouts": shutout_flag(goals_against, saves),
        "ot_losses": ot_loss_flag(decision),
    }
    return weighted_score([(parts[k], w) for k, w in weights.items()])


def ratio_or_null(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den as a 0..1 ratio, null when den is 0 or null."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def toi_to_seconds(toi: ColumnLike) -> Column:
    """``MM:SS`` -> seconds; anything else (null, one or three parts,
    letters, decimals, more seconds than an int holds) -> 0."""
    parts = F.split(_col(toi), ":")
    m = _try_int(F.try_element_at(parts, F.lit(1)))
    s = _try_int(F.try_element_at(parts, F.lit(2)))
    total = m.cast("bigint") * 60 + s.cast("bigint")
    ok = (F.size(parts) == 2) & total.between(-(2**31), 2**31 - 1)
    return F.when(ok, total).otherwise(F.lit(0)).cast("int")


def _try_int(c: Column) -> Column:
    # Integer text only: optional sign and digits, surrounding blanks allowed.
    txt = F.trim(c)
    return F.when(txt.rlike(r"^[+-]?[0-9]+$"), txt.try_cast("int"))


def seconds_to_minutes(seconds: ColumnLike) -> Column:
    """seconds -> minutes as a double."""
    return _col(seconds) / F.lit(60.0)


def display_round(c: ColumnLike, ndigits: int = 2) -> Column:
    """round at the edge only."""
    return F.round(_col(c), ndigits)


def label_or(c: ColumnLike, fallback: str = K.FREE_AGENT_LABEL) -> Column:
    """F16: a label, or a fixed text when it is missing."""
    return F.coalesce(_col(c), F.lit(fallback))
