from datetime import date, datetime

import pytest
from conftest import one
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventlink.functions import times


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("03/04/2016 05:06:07", datetime(2016, 4, 3, 5, 6, 7)),
        ("31/02/2016 05:06:07", None),
        ("2016-04-03 05:06:07", None),
        ("", None),
        (None, None),
    ],
)
def test_parse(spark, given, wanted):
    assert one(spark, times.parse(F.lit(given).cast("string"))) == wanted


def test_parse_day(spark):
    assert one(spark, times.parse_day(F.lit("03/04/2016"))) == date(2016, 4, 3)
    assert one(spark, times.parse_day(F.lit("03/04/16 x"))) is None


def test_parse_strict(spark):
    assert one(spark, times.parse_strict(F.lit("03/04/2016 05:06:07"))) == datetime(2016, 4, 3, 5, 6, 7)
    assert one(spark, times.parse_strict(F.lit(""))) is None
    assert one(spark, times.parse_strict(F.lit(None).cast("string"))) is None
    with pytest.raises(PySparkException, match="not a date and time"):
        one(spark, times.parse_strict(F.lit("soon")))


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("03/04/2016", datetime(2016, 4, 3)),
        ("3/4/2016 5:06", datetime(2016, 4, 3, 5, 6)),
        ("2016-04-03 05:06:07", datetime(2016, 4, 3, 5, 6, 7)),
        ("03/25/2016", datetime(2016, 3, 25)),
        ("never", None),
    ],
)
def test_parse_day_first(spark, given, wanted):
    assert one(spark, times.parse_day_first(F.lit(given))) == wanted


@pytest.mark.parametrize(
    ("given", "start", "end"),
    [
        ("08:30", "08:30:00", "08:30:00"),
        ("8:30:15", "08:30:15", "08:30:15"),
        ("10:30 pm", "22:30:00", "22:30:00"),
        ("Night shift", "22:00:00", "22:00:00"),
        ("tbc", "00:00:00", "23:59:59"),
        (None, "00:00:00", "23:59:59"),
    ],
)
def test_clock(spark, given, start, end):
    assert one(spark, times.clock(F.lit(given).cast("string"))) == start
    assert one(spark, times.clock(F.lit(given).cast("string"), end=True)) == end


def test_at_clock(spark):
    day = F.lit("2016-04-03").cast("date")
    assert one(spark, times.at_clock(day, F.lit("23:59:59"))) == datetime(2016, 4, 3, 23, 59, 59)
    assert one(spark, times.at_clock(F.lit(None).cast("date"), F.lit("23:59:59"))) is None


def test_calendar(spark):
    at = stamp("2026-12-01 06:30:36.75")
    assert one(spark, times.weekday(at)) == 1
    assert one(spark, times.decimal_hour(at)) == pytest.approx(6.51)
    assert one(spark, times.minute_of_day(at)) == 390
    assert one(spark, times.time_of_day(at)) == "06:30:36"
    wanted = date(2026, 12, 1).toordinal() + 6.51 / 24
    assert one(spark, times.ordinal_datetime(at)) == pytest.approx(wanted)


def test_epoch_seconds_ignores_the_session_zone(spark):
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        gap = one(spark, times.epoch_seconds(stamp("2016-03-27 01:30:00")))
        assert gap == int((datetime(2016, 3, 27, 1, 30) - datetime(1970, 1, 1)).total_seconds())
        assert one(spark, times.epoch_seconds(stamp("1969-12-31 23:59:59"))) == -1
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_latest(table):
    schema = "a timestamp_ntz,b timestamp_ntz,c timestamp_ntz"
    rows = table(
        schema,
        ("2016-01-01", "2016-01-02", None),
        ("2016-01-03", "2016-01-03", "2016-01-02"),
        (None, None, None),
    )
    found = rows.select(times.latest("a", "b", "c").alias("at"), times.latest_name("a", "b", "c").alias("name")).collect()
    assert [(r["at"], r["name"]) for r in found] == [
        (datetime(2016, 1, 2), "b"),
        (datetime(2016, 1, 3), "a"),
        (None, None),
    ]


def test_default_span(table):
    rows = table(
        "s timestamp_ntz,e timestamp_ntz", ("2016-01-01 10:00:00", None), (None, "2016-01-01 00:30:00"), (None, None)
    )
    start, end = times.default_span(F.col("s"), F.col("e"))
    found = [tuple(r) for r in rows.select(start, end).collect()]
    assert found == [
        (datetime(2016, 1, 1, 10), datetime(2016, 1, 1, 11)),
        (datetime(2015, 12, 31, 23, 30), datetime(2016, 1, 1, 0, 30)),
        (None, None),
    ]


def test_within_is_half_open_unless_closed(spark):
    at = stamp("2016-04-01 00:00:00")
    assert not one(spark, times.within(at, "2016-01-01", "2016-04-01"))
    assert one(spark, times.within(at, "2016-01-01", "2016-04-01", closed=True))
