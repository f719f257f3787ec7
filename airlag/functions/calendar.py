"""Calendar features of a date column (null date -> flags 0, season Fall)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: holiday windows as (month, first day, last day), inclusive,
# and the season of each month; any other month (and null) is Fall -----------
HOLIDAY_WINDOWS = [
    (11, 22, 28),   # Thanksgiving week
    (12, 20, 31),   # Christmas / New Year, December part
    (1, 1, 5),      # Christmas / New Year, January part
    (7, 1, 7),      # Independence Day week
    (5, 25, 31),    # Memorial Day
    (9, 1, 7),      # Labor Day week
]
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
}
DEFAULT_SEASON = "Fall"
# ----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_of_week(date_col) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(date_col))


def is_weekend(date_col) -> Column:
    return F.coalesce(F.weekday(_c(date_col)) >= 5, F.lit(False)).cast("int")


def is_holiday_period(date_col) -> Column:
    d = _c(date_col)
    m, day = F.month(d), F.dayofmonth(d)
    cond = reduce(
        lambda a, b: a | b,
        [(m == mo) & day.between(lo, hi) for mo, lo, hi in HOLIDAY_WINDOWS],
    )
    return F.coalesce(cond, F.lit(False)).cast("int")


def season(date_col) -> Column:
    m = F.month(_c(date_col))
    expr = None
    for name, months in SEASON_MONTHS.items():
        expr = (F.when(m.isin(*months), F.lit(name)) if expr is None
                else expr.when(m.isin(*months), F.lit(name)))
    return expr.otherwise(F.lit(DEFAULT_SEASON))


def year_month(date_col) -> Column:
    return F.date_format(_c(date_col), "yyyy-MM")
