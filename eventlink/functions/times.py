"""Dates and times: parsing, calendar features, spans.

Timestamps are TIMESTAMP_NTZ throughout: the sources have no time zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats and default times of the extracts.
DATE_FORMAT = "dd/MM/yyyy"
DATETIME_FORMAT = "dd/MM/yyyy HH:mm:ss"
LOGGER_FORMAT = "dd-MM-yyyy HH:mm"
DAY_FIRST_FORMATS = (
    "d/M/yyyy[ H:mm[:ss]]",
    "yyyy-MM-dd[ HH:mm[:ss]]",
    "yyyy-MM-dd'T'HH:mm[:ss]",
    "d-M-yyyy[ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "M/d/yyyy[ H:mm[:ss]]",
)
TIME_FORMATS = ("H:mm:ss", "H:mm", "h:mm a", "h:mma", "h a", "ha", "yyyy-MM-dd HH:mm:ss", "d/M/yyyy H:mm")
NIGHT_TIME = "22:00:00"
START_OF_DAY = "00:00:00"
END_OF_DAY = "23:59:59"

EPOCH = "1970-01-01"


def parse(text: Column, fmt: str = DATETIME_FORMAT) -> Column:
    """Fixed format; anything else becomes null."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def parse_day(text: Column, fmt: str = DATE_FORMAT) -> Column:
    return parse(text, fmt).cast("date")


def parse_strict(text: Column, fmt: str = DATETIME_FORMAT) -> Column:
    """Blank is null; any other text that does not follow the format is an error."""
    failure = F.raise_error(F.concat(F.lit("not a date and time: "), text)).cast("timestamp_ntz")
    return F.when(text != "", F.coalesce(parse(text, fmt), failure))


def parse_day_first(text: Column) -> Column:
    """Day before month where both readings are possible; ISO text is read as ISO."""
    return F.coalesce(*[parse(F.trim(text), fmt) for fmt in DAY_FIRST_FORMATS])


def parse_joined(date: Column, time: Column, fmt: str = DATETIME_FORMAT) -> Column:
    return parse(F.concat(date, F.lit(" "), time), fmt)


def clock(text: Column, end: bool = False) -> Column:
    """Time typed by hand as ``HH:mm:ss``.

    Unreadable text that speaks of the night is 22:00; the rest, blanks too, opens or closes the day.
    """
    read = [F.try_to_timestamp(F.upper(F.trim(text)), F.lit(fmt)) for fmt in TIME_FORMATS]
    night = F.when(F.lower(text).contains("night"), F.lit(NIGHT_TIME))
    default = F.lit(END_OF_DAY if end else START_OF_DAY)
    return F.coalesce(F.date_format(F.coalesce(*read), "HH:mm:ss"), night, default)


def at_clock(date: Column, hms: Column) -> Column:
    """Date plus ``HH:mm:ss``."""
    day = F.date_format(date, "yyyy-MM-dd")
    return parse(F.concat(day, F.lit(" "), hms), "yyyy-MM-dd HH:mm:ss")


def seconds(n: int | float) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def hours(n: int | float) -> Column:
    return seconds(n * 3600)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 by the wall clock, whatever the session's time zone."""
    day = F.datediff(ts.cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_minutes(ts: Column) -> Column:
    """Whole minutes since 1970 by the wall clock."""
    day = F.datediff(ts.cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")
    return day * 1440 + F.hour(ts) * 60 + F.minute(ts)


def day_start(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def decimal_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600


def ordinal_datetime(ts: Column) -> Column:
    """Days since the year 1, the first counting as 1, plus the fraction of the day."""
    return F.datediff(ts.cast("date"), F.lit("0001-01-01").cast("date")) + 1 + decimal_hour(ts) / 24


def minute_of_day(ts: Column) -> Column:
    return F.minute(ts) + 60 * F.hour(ts)


def latest(*cols: str) -> Column:
    """Latest of several columns, nulls left out."""
    return F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])


def latest_name(*cols: str) -> Column:
    """Name of the column holding the latest value; the first named wins a tie."""
    top = latest(*cols)
    return F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in cols])


def finish(frame_columns: list[str], actual: tuple[str, ...], completed: str) -> Column:
    """Actual finish where the table has that column, else the completion date."""
    return F.coalesce(*[F.col(c) for c in (*actual, completed) if c in frame_columns])


def default_span(start: Column, end: Column, length_hours: int = 1) -> tuple[Column, Column]:
    """Fill a missing start from the end, then a missing end from the start."""
    filled_start = F.coalesce(start, end - hours(length_hours))
    return filled_start, F.coalesce(end, filled_start + hours(length_hours))


def within(ts: Column, start, end, closed: bool = False) -> Column:
    """Half-open ``[start, end)`` by default."""
    lower, upper = (F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else v for v in (start, end))
    return (ts >= lower) & ((ts <= upper) if closed else (ts < upper))


def any_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
