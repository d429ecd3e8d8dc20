"""RFC 2822 date parsing (C11) as native Column expressions.

Follows the tokenising rules of Python's ``email.utils.parsedate_tz``:
optional weekday, day and month in either order, 2-digit years mapped to
1969–2068, ``HH:MM[:SS]``, a numeric or named zone, trailing tokens such as
``(UTC)`` ignored.  ``-0000`` and a missing/unknown zone give a *naive*
time, which the build reads as UTC (``tz_known`` = false).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from .common import let as _let

WS = cfg.PY_WHITESPACE_CLASS
_DAYS = "mon|tue|wed|thu|fri|sat|sun"
DATE_RX = (
    rf"(?d)^{WS}*(?:[^{WS[1:-1]},]*,{WS}*|(?i:{_DAYS}){WS}+)?"
    rf"(?:(\d{{1,2}}),?{WS}+([A-Za-z]+)|([A-Za-z]+){WS}+(\d{{1,2}}),?)"
    rf"{WS}+(\d{{1,4}}),?{WS}+(\d{{1,2}}):(\d{{1,2}})(?::(\d{{1,2}}))?"
    rf"(?:{WS}*([+-]\d+)|{WS}+([^{WS[1:-1]}]+))?(?:{WS}.*)?$"
)


_SEP = "\u0001"
_NGROUPS = 10


def _groups(s: Column) -> Column:
    """All capture groups in one regex pass: ['', g1, ..., g10] when the
    whole string matches (non-participating groups are ''), else NULL."""
    rep = "".join(f"{_SEP}${i}" for i in range(1, _NGROUPS + 1))
    r = F.regexp_replace(s, DATE_RX, rep)
    return F.when(r.startswith(_SEP) & (r != s), F.split(r, _SEP))


def _fields(g: Column) -> Column:
    def grp(i: int) -> Column:
        return F.nullif(g[i], F.lit(""))

    months = F.array(*[F.lit(m) for m in cfg.MONTH_ABBR + cfg.MONTH_FULL])
    pos = F.array_position(months, F.lower(F.coalesce(grp(2), grp(3))))
    yy = grp(5).cast("int")
    zone_map = F.create_map(*[v for k, n in cfg.ZONE_OFFSETS_HHMM.items() for v in (F.lit(k), F.lit(n))])
    num_zone, name_zone = grp(9), grp(10)
    hhmm = F.coalesce(F.when(num_zone.rlike(r"^[+-]\d{1,9}$"), num_zone.cast("int")),
                      zone_map[F.upper(name_zone)],
                      F.when(name_zone.rlike(r"^[+-]?\d{1,9}$"), name_zone.cast("int")))
    return F.struct(
        F.coalesce(grp(1), grp(4)).cast("int").alias("day"),
        F.when(pos > 0, ((pos - 1) % 12) + 1).alias("month"),
        F.when(yy < 100, F.when(yy > 68, yy + 1900).otherwise(yy + 2000)).otherwise(yy).alias("year"),
        grp(6).cast("int").alias("hh"),
        grp(7).cast("int").alias("mi"),
        F.coalesce(grp(8).cast("int"), F.lit(0)).alias("ss"),
        F.when(~((hhmm == 0) & F.coalesce(num_zone, name_zone).startswith("-")), hhmm).alias("hhmm"),
    )


def _result(p: Column) -> Column:
    valid = (p["month"].isNotNull() & p["hh"].between(0, 23) & p["mi"].between(0, 59)
             & p["ss"].between(0, 59) & (p["year"] >= 1))
    z = p["hhmm"]
    off = F.signum(z).cast("int") * ((F.abs(z) / 100).cast("int") * 3600 + (F.abs(z) % 100) * 60)
    local = F.when(valid, F.try_make_timestamp_ntz(p["year"], p["month"], p["day"], p["hh"], p["mi"], p["ss"]))

    def fin(loc: Column) -> Column:
        o = F.when(loc.isNotNull(), off)
        return F.struct(
            F.timestamp_seconds(F.unix_seconds(loc.cast("timestamp")) - F.coalesce(o, F.lit(0))).alias("ts"),
            loc.alias("local_ts"),
            o.alias("offset_s"),
            F.when(loc.isNotNull(), o.isNotNull()).alias("tz_known"),
            loc.isNotNull().alias("date_ok"),
        )
    return _let(local, fin)


def parse_rfc2822(s: Column) -> Column:
    """C11: STRUCT<ts TIMESTAMP, local_ts TIMESTAMP_NTZ, offset_s INT,
    tz_known BOOLEAN, date_ok BOOLEAN>.  ``ts`` is the instant (naive → UTC),
    ``local_ts`` the wall clock in the message's own offset."""
    return _let(_groups(s), lambda g: _let(_fields(g), _result))


FIELDS = ("ts", "local_ts", "offset_s", "tz_known", "date_ok")


def with_parsed_date(df: DataFrame, col: str = "date", prefix: str = "") -> DataFrame:
    """Add the parsed fields as top-level columns.

    The struct is emitted through ``inline`` (a Generate node): filters on
    the parsed fields stay above it instead of being pushed down with a copy
    of the whole parser, so each scan parses a date once.
    """
    x = df.select(*df.columns, F.inline(F.array(parse_rfc2822(F.col(col)))))
    return x.select(*df.columns, *[F.col(f).alias(prefix + f) for f in FIELDS]) if prefix else x
