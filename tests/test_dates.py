"""RFC 2822 parsing (C11) against Python's email.utils on the same strings."""

import datetime as dt
from email.utils import parsedate_to_datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from briefkit.functions.dates import with_parsed_date

CASES = [
    "Mon, 01 Jan 2024 12:00:00 +0000",
    "1 Jan 2024 12:00 +0530",
    "Tue, 02 Jan 2024 08:30:00 -0500",
    "Tue, 02 Jan 2024 08:30:00 -0000",
    "Wed, 03 Jan 2024 10:00:00 GMT",
    "Wed, 03 Jan 2024 10:00:00 EST",
    "Thu, 04 Jan 2024 10:00:00 +0000 (UTC)",
    "05 Jan 24 23:59:59 +0100",
    "06 January 2024 01:02:03 +0000",
    "Jan 07 2024 01:02:03 +0000",
    "08 Jan 2024 01:02:03",
    "2024-01-01",
    "Invalid date format",
    "32 Jan 2024 10:00:00 +0000",
    "01 Foo 2024 10:00:00 +0000",
    "01 Jan 2024 24:00:00 +0000",
    "",
]


def python_view(s):
    try:
        d = parsedate_to_datetime(s)
    except (TypeError, ValueError, IndexError):
        return None
    if d is None:
        return None
    off = None if d.tzinfo is None else int(d.utcoffset().total_seconds())
    inst = d.replace(tzinfo=None) - dt.timedelta(seconds=off or 0)
    return (d.replace(tzinfo=None), inst, off)


def spark_view(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ord long, date string")
    rows = with_parsed_date(df).orderBy("ord").collect()
    out = []
    for r in rows:
        if not r.date_ok:
            out.append(None)
        else:
            out.append((r.local_ts, r.ts.replace(tzinfo=None) if r.ts.tzinfo else r.ts, r.offset_s))
    return out


def test_cases_match_python(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = spark_view(spark, CASES)
    for s, g in zip(CASES, got):
        assert g == python_view(s), s


def test_null_date(spark):
    df = spark.createDataFrame([(1, None)], "ord long, date string")
    r = with_parsed_date(df).first()
    assert r.date_ok is False and r.ts is None


@settings(max_examples=40, deadline=None)
@given(st.datetimes(min_value=dt.datetime(1970, 1, 2), max_value=dt.datetime(2060, 1, 1)).map(lambda d: d.replace(microsecond=0)),
       st.sampled_from(["+0000", "-0700", "+0545", "-0000", "GMT", "PST", "EDT", ""]),
       st.sampled_from(["%a, %d %b %Y %H:%M:%S", "%d %b %Y %H:%M", "%a, %d %B %Y %H:%M:%S", "%d %b %y %H:%M:%S"]))
def test_roundtrip_property(spark, d, zone, fmt):
    s = (d.strftime(fmt) + " " + zone).strip()
    assert spark_view(spark, [s]) == [python_view(s)]
