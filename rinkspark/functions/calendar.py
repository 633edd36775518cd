"""League calendar functions: local dates, ISO week keys, matchup text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rinkspark import constants as K
from rinkspark.functions.scoring import ColumnLike, _col


def parse_instant(text: ColumnLike) -> Column:
    """ISO instant text such as ``2025-11-10T00:30:00Z`` -> timestamp;
    unparsable text -> null (C2 skips such games)."""
    return F.try_to_timestamp(_col(text))


def local_time(ts: ColumnLike, tz: str = K.LEAGUE_TIME_ZONE) -> Column:
    """Wall-clock time (timestamp_ntz) in the league zone of a UTC instant.

    A ``timestamp_ntz`` input is read as UTC wall time and converted with
    ``convert_timezone``, independent of the session zone. A ``timestamp``
    input is first rendered in the session zone, which must be UTC (the
    library's sessions pin it)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts).cast("timestamp_ntz"))


def league_date(ts: ColumnLike, tz: str = K.LEAGUE_TIME_ZONE) -> Column:
    """F8: UTC instant -> league-zone calendar date."""
    return F.to_date(local_time(ts, tz))


def iso_year(d: ColumnLike) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(d).cast("date"))


def iso_week(d: ColumnLike) -> Column:
    return F.weekofyear(_col(d).cast("date"))


def week_key_of_date(d: ColumnLike) -> Column:
    """``YYYY-Www`` ISO week key of a date."""
    return F.format_string("%d-W%02d", iso_year(d), iso_week(d))


def week_key(ts: ColumnLike, tz: str = K.LEAGUE_TIME_ZONE) -> Column:
    """UTC instant -> league zone -> ISO (year, week) -> ``YYYY-Www``."""
    return week_key_of_date(league_date(ts, tz))


def week_monday(year: ColumnLike, week: ColumnLike) -> Column:
    """Monday of ISO week ``week`` of ``year`` (week 1 holds 4 January)."""
    jan4 = F.make_date(_col(year), F.lit(1), F.lit(4))
    week1_monday = F.date_sub(jan4, F.weekday(jan4))
    return F.date_add(week1_monday, (_col(week) - 1) * 7)


def week_bounds(year: ColumnLike, week: ColumnLike) -> tuple[Column, Column]:
    """(Monday, Sunday) of an ISO week."""
    monday = week_monday(year, week)
    return monday, F.date_add(monday, 6)


def week_bounds_of_key(key: ColumnLike) -> tuple[Column, Column]:
    """F7 from a ``YYYY-Www`` key."""
    parts = F.split(_col(key), "-W")
    return week_bounds(parts.getItem(0).cast("int"), parts.getItem(1).cast("int"))


def week_start(d: ColumnLike) -> Column:
    """Monday of the week holding ``d``."""
    return F.date_trunc("week", _col(d).cast("timestamp")).cast("date")


def week_end(d: ColumnLike) -> Column:
    """Sunday of the week holding ``d``."""
    return F.date_add(week_start(d), 6)


def matchup_text(is_home: ColumnLike, opponent: ColumnLike, on_date: ColumnLike | None = None) -> Column:
    """``vs AWY`` for the home side, ``@ HOM`` for the away side,
    optionally followed by `` (YYYY-MM-DD)``."""
    text = F.concat(F.when(_col(is_home), F.lit("vs ")).otherwise(F.lit("@ ")), _col(opponent))
    if on_date is None:
        return text
    return F.concat(text, F.lit(" ("), F.date_format(_col(on_date), "yyyy-MM-dd"), F.lit(")"))


def matchup_items(opponents: ColumnLike) -> Column:
    """F10, first half: the ``", "``-joined list as an array."""
    return F.split(_col(opponents), ", ")


def matchup_code(item: ColumnLike) -> Column:
    """F10, second half: the last word of one matchup is the team code."""
    return F.element_at(F.split(_col(item), " "), -1)
