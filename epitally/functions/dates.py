"""Date parsing and day arithmetic.

Surveillance files hold dates as text. A value that is no date becomes null, and text
after a complete date is ignored.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day zero of the two calendars in use.
EPOCH_DEC31 = dt.date(2019, 12, 31)
EPOCH_JAN1 = dt.date(2020, 1, 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_iso_date(c: Column | str) -> Column:
    """``2020-06-01`` and ``2020-6-1``, with or without text behind it.

    The ten-character form is cast directly; only other texts reach the pattern.
    """
    text = _col(c)
    head = F.substring(text, 1, 10)
    full = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-") & (F.length(head) == 10)
    loose = F.regexp_extract(text, r"^\s*(\d{4}-\d{1,2}-\d{1,2})", 1)
    return F.coalesce(F.when(full, head.try_cast("date")), F.try_to_date(loose, "y-M-d"))


def parse_us_date(c: Column | str) -> Column:
    """``6/1/2020``: month, day, year, one or two digits each for the first two.

    The plain form is read directly; only longer texts reach the pattern.
    """
    text = _col(c)
    loose = F.regexp_extract(text, r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1)
    plain = F.length(text).between(8, 10)
    return F.coalesce(F.when(plain, F.try_to_date(text, "M/d/yyyy")), F.try_to_date(loose, "M/d/yyyy"))


def parse_long_date(c: Column | str) -> Column:
    """``June 5, 2020``; the month may be in any case or shortened to three letters."""
    text = F.initcap(F.regexp_extract(_col(c), r"^\s*([A-Za-z]+ \d{1,2}, \d{4})", 1))
    return F.coalesce(F.try_to_date(text, "MMMM d, yyyy"), F.try_to_date(text, "MMM d, yyyy"))


def day_offset(c: Column | str, epoch: dt.date = EPOCH_DEC31) -> Column:
    """Days since the epoch."""
    return F.datediff(_col(c), F.lit(epoch))


def offset_date(c: Column | str, epoch: dt.date = EPOCH_DEC31) -> Column:
    """The date that lies the given number of days after the epoch."""
    return F.date_add(F.lit(epoch), _col(c).cast("int"))


def lag_days(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))


def impute_date(observed: Column | str, fallback: Column | str, lag: Column | str) -> Column:
    """The observed date, or where it is missing the fallback date less the lag."""
    return F.coalesce(_col(observed), F.date_sub(_col(fallback), _col(lag).cast("int")))


def weeks_after(c: Column | str, origin: Column | str) -> Column:
    """Whole weeks from origin, rounded half to even, never below zero; missing where a date is."""
    weeks = F.bround(F.datediff(_col(c), _col(origin)) / F.lit(7.0), 0)
    return F.when(weeks < 0, 0.0).otherwise(weeks)


def week_start(c: Column | str) -> Column:
    """Monday of the week that holds the date."""
    return F.date_trunc("week", _col(c)).cast("date")
