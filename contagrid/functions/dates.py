"""Date expressions. Nothing reads the clock: callers pass ``as_of``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, functions as F

from contagrid.fixed_values import AGE_BANDS

# places of day, month and year in a written date
DAY_MONTH_YEAR = "dmy"
MONTH_DAY_YEAR = "mdy"
YEAR_MONTH_DAY = "ymd"

# A date is read by one expression, with an alternative for each order and form.
_DAY, _MONTH = "(0?[1-9]|[12][0-9]|3[01])", "(0?[1-9]|1[0-2])"
_FULL_DAY, _FULL_MONTH = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])"
#: Put behind each text: a two-digit year takes its century from there.
_CENTURIES = "|2019"
#: Year as written, what stands between the parts, and the part of ``_CENTURIES`` that is its century.
_FORMS = (
    ("([0-9]{4})", "[-./]", "2019"),
    ("([0-5][0-9]|6[0-8])", "[-./]", "(20)19"),
    ("([0-9]{2})", "[-./]", "20(19)"),
    # without separators, only a year of our times tells the orders apart
    ("(1[89][0-9]{2}|[2-9][0-9]{3})", "", "2019"),
)
_TIME = " (?:[01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]"


def _reader(orders: tuple[str, ...], behind: str = "") -> tuple[str, str]:
    """The expression for dates in these orders, with ``behind`` after them, and the replacement in ISO order."""
    found = {"c": "", "y": "", "m": "", "d": ""}
    alternatives, groups = [], 0
    for order in orders:
        for year, between, century in _FORMS:
            shapes = {"y": year, "m": _MONTH if between else _FULL_MONTH, "d": _DAY if between else _FULL_DAY}
            for part in order + ("c" if "(" in century else ""):
                groups += 1
                found[part] += f"${groups}"
            alternatives.append(between.join(shapes[x] for x in order) + rf"{behind} *\|{century}")
    return f"^ *(?:{'|'.join(alternatives)})$", f"{found['c']}{found['y']}-{found['m']}-{found['d']}"


def _read(c: Column, orders: tuple[str, ...], behind: str = "") -> Column:
    pattern, iso = _reader(orders, behind)
    return F.regexp_replace(F.concat(c, F.lit(_CENTURIES)), pattern, iso).try_cast("date")


def parse_date(c: Column, *orders: str) -> Column:
    """The date in the first of ``orders`` that day and month fit; '-', '.' and '/' stand between the parts.

    Years have four digits or two (00-68 in this century, 69-99 in the last), and
    eight digits need no separators. One expression per value puts the parts in ISO order, to be
    cast; a text it doesn't fit is no date, and neither is an impossible day. Pattern-based
    parsing raises and catches an exception for each text that does not
    fit, which is what most texts do for all but one of the patterns.
    """
    return _read(c, orders)


def unreadable(c: Column, *orders: str) -> Column:
    """True where something is written that gives no date."""
    return (F.trim(c) != "") & parse_date(c, *orders).isNull()


def parse_datetime_as_date(c: Column, order: str = DAY_MONTH_YEAR) -> Column:
    """Date of a text with date and time; the time must be a valid one."""
    return _read(c, (order,), _TIME)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is evaluated once however often ``f`` uses it.

    An expression used twice is otherwise written out twice in filters,
    branches and all that they are pushed into.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def previous_week(as_of: date) -> tuple[date, date]:
    """Monday and Sunday of the full week before ``as_of``."""
    start = monday(as_of) - timedelta(days=7)
    return start, start + timedelta(days=6)


def snapshot_monday(as_of: date, offset: int) -> date:
    """Monday of the snapshot ``offset`` weeks from the week of ``as_of``.

    The study week is offset -1; the two older snapshots are -2 and -3.
    """
    return monday(as_of) + timedelta(weeks=offset)


def iso_year_week(day: date) -> tuple[int, int]:
    year, week, _ = day.isocalendar()
    return year, week


def week_start(c: Column) -> Column:
    return F.date_trunc("week", c).cast("date")


def iso_week(c: Column) -> Column:
    return F.weekofyear(c)


def iso_year(c: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), c.cast("date"))


def in_previous_week(c: Column, as_of: date) -> Column:
    low, high = previous_week(as_of)
    return c.between(F.lit(low), F.lit(high))


def null_unless_between(c: Column, low: date, high: date) -> Column:
    return once(c, lambda day: F.when(day.between(F.lit(low), F.lit(high)), day))


def age_years(birth: Column, as_of: date) -> Column:
    """Completed years on ``as_of``."""
    return F.floor(F.months_between(F.lit(as_of), birth) / 12).cast("int")


def age_band(age: Column, bands=AGE_BANDS) -> Column:
    """Band label of an age: one lookup in a constant array with an entry per year."""
    oldest = max(low for _, low, _ in bands if low is not None)
    years = [F.array_repeat(F.lit(b), (high if high is not None else oldest) - (low or 0) + 1) for b, low, high in bands]
    return once(age, lambda a: F.get(F.concat(*years), F.when(a > oldest, F.lit(oldest)).otherwise(a)))
