"""Date specs of the report language and the date buckets of pivots.

Absolute specs are resolved to literal dates; relative ones count from an anchor, which is a date or a column of the plan
(a scalar subquery over the facts), so no query runs while another is built. Buckets are column expressions.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed value: the grammar of relative dates ---
RELATIVE_SPEC = re.compile(r"-?(\d+)([dwmy])")
_FLEX_SPEC = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?")
_DAYS = {"d": 1, "w": 7}
_MONTHS = {"m": 1, "y": 12}


def _period_edge(first_month: int, months: int, first_day: bool) -> date:
    """First or last day of a period of ``months`` months; months are counted from year 0."""

    def opening(month: int) -> date:
        return date(month // 12, month % 12 + 1, 1)

    return opening(first_month) if first_day else opening(first_month + months) - timedelta(days=1)


def parse_flex_date(text: str, first_day: bool) -> date | None:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``; a year or month gives its first (from) or last (to) day."""
    m = _FLEX_SPEC.fullmatch(text)
    if not m:
        return None
    year, month, day = (g and int(g) for g in m.groups())
    try:
        if day is not None:
            return date(year, month, day)
        start = date(year, month or 1, 1)
        return _period_edge(start.year * 12 + start.month - 1, 12 if month is None else 1, first_day)
    except ValueError:
        return None


def parse_relative_date(spec: str, anchor: date, first_day: bool) -> date | None:
    """``-?N[dwmy]`` back from ``anchor``: N days or weeks (N > 0), or an edge of the N-th month or year back.

    Months and years are whole periods: the one that holds the anchor is number 0.
    """
    m = RELATIVE_SPEC.fullmatch(spec or "")
    if not m:
        return None
    n, unit = int(m[1]), m[2]
    if unit in _DAYS:
        return anchor - timedelta(days=n * _DAYS[unit]) if n else None
    length = _MONTHS[unit]
    period = (anchor.year * 12 + anchor.month - 1) // length - n
    return _period_edge(period * length, length, first_day)


def relative_date(spec: str, anchor: Column, first_day: bool) -> Column | None:
    """``parse_relative_date`` for an anchor that is known when the query runs only."""
    m = RELATIVE_SPEC.fullmatch(spec or "")
    if not m:
        return None
    n, unit = int(m[1]), m[2]
    if unit in _DAYS:
        return F.date_sub(anchor, n * _DAYS[unit]) if n else None
    length = _MONTHS[unit]
    month = (F.floor((F.year(anchor) * 12 + F.month(anchor) - 1) / length) - n) * length
    opening = F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))
    return opening if first_day else F.date_sub(F.add_months(opening, length), 1)


def resolve_date_spec(spec: str, first_day: bool, anchor: date | Column | None) -> date | Column | None:
    """Relative spec when it matches (needs ``anchor``), else an absolute one. A Column as anchor gives a Column."""
    if not RELATIVE_SPEC.fullmatch(spec or ""):
        return parse_flex_date(spec, first_day)
    if isinstance(anchor, Column):
        return relative_date(spec, anchor, first_day)
    return None if anchor is None else parse_relative_date(spec, anchor, first_day)


def year_end(d: Column) -> Column:
    """Pivot bucket for ``yyyy``: Dec 31 of the year."""
    return F.make_date(F.year(d), F.lit(12), F.lit(31))


def month_start(d: Column) -> Column:
    """Pivot bucket for ``yyyymm`` and monthly consolidation: first day of the month."""
    return F.trunc(d, "month")


def decade_label(d: Column) -> Column:
    """``1990-1999`` style label of a date's decade."""
    start = (F.floor(F.year(d) / 10) * 10).cast("int")
    return F.concat(start.cast("string"), F.lit("-"), (start + 9).cast("string"))
