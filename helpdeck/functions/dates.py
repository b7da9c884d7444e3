"""Text-date Column expressions.

Dates are stored as text in two layouts: ``yyyy-MM-dd HH:mm:ss`` (UTC+7
wall clock) for *_at columns and ``dd/MM/yyyy`` (sometimes ``yyyy-MM-dd``)
for tanggal_* columns. Parsing always uses the ``try_`` forms so bad text
becomes NULL instead of failing the job under ANSI mode. ``now`` is always
an argument so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helpdeck.functions._util import as_col, lit_or_col

TS_FMT = "yyyy-MM-dd HH:mm:ss"
ISO_FMT = "yyyy-MM-dd"
DMY_FMT = "dd/MM/yyyy"


def now_ts(now) -> Column:
    """A fixed clock value (text ``yyyy-MM-dd HH:mm:ss`` or Column) as a
    wall-clock TIMESTAMP_NTZ: formatting and interval arithmetic on it do not
    depend on the session time zone."""
    return F.to_timestamp_ntz(F.lit(now), F.lit(TS_FMT)) if not isinstance(now, Column) else now


def epoch_ntz() -> Column:
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"), F.lit(TS_FMT))


def epoch_seconds(ts) -> Column:
    """Seconds since 1970-01-01 00:00:00 of a wall-clock timestamp (NTZ; an
    instant is first read as the session's wall clock). Time-zone free."""
    return F.timestamp_diff("SECOND", epoch_ntz(), as_col(ts).cast("timestamp_ntz"))


def epoch_text(seconds) -> Column:
    """Inverse of ``epoch_seconds`` as ``yyyy-MM-dd HH:mm:ss`` text."""
    return F.date_format(F.timestamp_add("SECOND", as_col(seconds), epoch_ntz()), TS_FMT)


def text_seconds(c) -> Column:
    """``julianday``-style seconds of ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``
    text, by date and clock arithmetic (no time zone involved); anything
    else, or an impossible date/time, is NULL."""
    c = as_col(c)
    day = F.try_to_date(F.substring(c, 1, 10), ISO_FMT)
    days = F.datediff(day, F.to_date(F.lit("1970-01-01")))
    hh, mm, ss = (F.substring(c, p, 2).try_cast("int") for p in (12, 15, 18))
    full = c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$") & (hh < 24) & (mm < 60) & (ss < 60)
    date_only = c.rlike(r"^\d{4}-\d{2}-\d{2}$")
    secs = days.cast("long") * 86400
    return (F.when(full, secs + hh * 3600 + mm * 60 + ss)
            .when(date_only, secs))


def text_ts(c) -> Column:
    """Text -> wall-clock TIMESTAMP_NTZ (``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd``); else NULL."""
    return F.timestamp_add("SECOND", text_seconds(c), epoch_ntz())


def text_date(c) -> Column:
    """Text date in either layout (``dd/MM/yyyy`` or ``yyyy-MM-dd``) -> DATE; else NULL."""
    c = as_col(c)
    return F.coalesce(F.try_to_date(c, DMY_FMT), F.try_to_date(c, ISO_FMT))


def iso_prefix_date(c) -> Column:
    """``julianday(substr(x,1,10))``: the first 10 characters as an ISO date."""
    return F.try_to_date(F.substring(as_col(c), 1, 10), ISO_FMT)


def whole_days(later, earlier) -> Column:
    """H9 whole-day difference of the date parts of two ``*_at`` texts."""
    return F.datediff(iso_prefix_date(later), iso_prefix_date(earlier))


def frac_days(later_text, earlier_text) -> Column:
    """H9 fractional day difference ``julianday(a) - julianday(b)`` of two texts."""
    later = text_seconds(lit_or_col(later_text))
    return (later - text_seconds(earlier_text)) / F.lit(86400.0)


def today_str(now) -> Column:
    """H5 ``todayStr``: the clock's date as ``dd/MM/yyyy``."""
    return F.date_format(now_ts(now), DMY_FMT)


def wib_text(ts) -> Column:
    """H6 ``nowWIB``: a UTC clock value as UTC+7 wall-clock text (Western
    Indonesia has no daylight saving: a fixed +7 hours)."""
    t = now_ts(ts) if isinstance(ts, str) else as_col(ts).cast("timestamp_ntz")
    return F.date_format(t + F.make_interval(hours=F.lit(7)), TS_FMT)


def _swap3(c, sep_in: str, sep_out: str) -> Column:
    c = as_col(c)
    parts = F.split(c, sep_in)
    swapped = F.concat_ws(sep_out, parts.getItem(2), parts.getItem(1), parts.getItem(0))
    return (F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
            .when(F.size(parts) == 3, swapped)
            .otherwise(c))


def dmy_to_iso(c) -> Column:
    """H2 ``toISODate``: ``dd/MM/yyyy`` -> ``yyyy-MM-dd``; other shapes unchanged; '' -> NULL."""
    return _swap3(c, "/", "-")


def iso_to_dmy(c) -> Column:
    """H3/H4 ``toDDMMYYYY``: ``yyyy-MM-dd`` -> ``dd/MM/yyyy``; other shapes unchanged; '' -> NULL."""
    return _swap3(c, "-", "/")


def reassembled_iso(c) -> Column:
    """H8 parity form of ``substr(t,7,4)||'-'||substr(t,4,2)||'-'||substr(t,1,2)``.

    On ISO input this yields nonsense text, exactly as the reference does.
    """
    c = as_col(c)
    return F.concat(F.substring(c, 7, 4), F.lit("-"), F.substring(c, 4, 2), F.lit("-"), F.substring(c, 1, 2))


def month_match(c, year: int, month: int) -> Column:
    """B7: text date in the given month, either ``%/MM/YYYY`` or ``YYYY-MM-%``."""
    c = as_col(c)
    mm = f"{month:02d}"
    return c.endswith(f"/{mm}/{year}") | c.startswith(f"{year}-{mm}-")


def round_half_up(x, digits: int = 1) -> Column:
    """H20 ``Math.round(x*10^d)/10^d``: halves go toward +infinity."""
    scale = float(10 ** digits)
    return F.floor(as_col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def default_expiry(given, now) -> Column:
    """H24: the given ``yyyy-MM-dd`` text, or 30 days after the UTC date of the (UTC+7) clock."""
    utc = now_ts(now) - F.expr("INTERVAL 7 HOURS")
    return F.coalesce(F.nullif(lit_or_col(given).cast("string"), F.lit("")),
                      F.date_format(F.date_add(F.to_date(utc), 30), ISO_FMT))


def first_weekday(year: int, month: int) -> Column:
    """H22 weekday of the 1st (Sunday = 0)."""
    return F.dayofweek(F.make_date(F.lit(year), F.lit(month), F.lit(1))) - 1


def days_in_month(year: int, month: int) -> Column:
    """H22 number of days in the month."""
    return F.dayofmonth(F.last_day(F.make_date(F.lit(year), F.lit(month), F.lit(1))))


def step_month(year: int, month: int, delta: int) -> tuple[int, int]:
    """H21 month stepping across year ends (a driver-side parameter helper)."""
    m0 = year * 12 + (month - 1) + delta
    return m0 // 12, m0 % 12 + 1
