"""Message and log selection."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sender_email


def _as_date(d) -> dt.date:
    return d.date() if isinstance(d, dt.datetime) else d


def message_predicate(as_of: dt.date | dt.datetime | None = None, days: int | None = None,
                      label: str | None = None, from_email: str | None = None,
                      to_email: str | None = None, ts_col: str = "received_ts",
                      date_col: str | None = None) -> Column:
    """B1–B5 as one conjunction; absent parts are dropped.

    Works on ``ts_col`` (the server receipt instant, as the mail search
    does), ``labels`` (array), ``sender`` and ``recipient``; ``date_col``
    names a date partition column of stored messages to prune on.  ``as_of`` is a parameter, never the
    clock, so reruns are reproducible.  B1 is date-granular: every message
    on or after ``as_of - days`` (calendar date, UTC) passes.
    """
    preds: list[Column] = []
    if days is not None and as_of is not None:
        cutoff = _as_date(as_of) - dt.timedelta(days=days)
        preds.append(F.col(ts_col) >= F.lit(dt.datetime.combine(cutoff, dt.time())))
        if date_col:
            preds.append(F.col(date_col) >= F.lit(cutoff))  # partition pruning on stored messages
    if label:
        preds.append(F.array_contains(F.col("labels"), label))
    if from_email:
        preds.append(F.coalesce(sender_email(F.col("sender")), F.col("sender")) == from_email)
    if to_email:
        preds.append(F.coalesce(sender_email(F.col("recipient")), F.col("recipient")) == to_email)
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def select_messages(df: DataFrame, **kw) -> DataFrame:
    """One filter; Catalyst pushes its scan-level parts into the reader."""
    if kw.get("date_col") is None:
        kw.pop("date_col", None)
    return df.where(message_predicate(**kw))


def cost_cutoff(as_of: dt.datetime, days: int | None) -> str | None:
    """ISO cutoff string, or None for no filter (days falsy)."""
    if not days:
        return None
    return (as_of - dt.timedelta(days=days)).isoformat()


def cost_lookback(log: DataFrame, as_of: dt.datetime, days: int | None) -> DataFrame:
    """Lexicographic ``timestamp >= cutoff``; a missing timestamp is ''.
    A log with a ``day`` partition (the day its time starts with, NULL if it
    starts with none) is read from the cutoff's day on."""
    cutoff = cost_cutoff(as_of, days)
    if cutoff is None:
        return log
    if "day" in log.columns:
        log = log.where((F.col("day") >= F.lit(dt.date.fromisoformat(cutoff[:10]))) | F.col("day").isNull())
    return log.where(F.coalesce(F.col("timestamp"), F.lit("")) >= F.lit(cutoff))


def unverified(registry: DataFrame) -> DataFrame:
    """Registry rows still waiting for review."""
    return registry.where(~F.coalesce(F.col("verified"), F.lit(False)))
