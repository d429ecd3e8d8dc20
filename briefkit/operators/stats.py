"""Per-source statistics, date extent and the latest-24h slice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.dates import with_parsed_date
from ..functions.text import clean_subject, is_breaking, short_sender
from ..session import stored
from .bloom import may_hold
from .sequence import global_rank


#: Order of records without one: after all others.
_LAST = (1 << 62) - 1


def keyed(records: DataFrame, *cols) -> DataFrame:
    """Records with their place ``_o`` (NULL ``ord`` last) and, for records
    that share it, ``_t`` (hash of the message id, or of subject and date)."""
    tie = [c for c in ("msg_id",) if c in records.columns] or ["subject", "date"]
    return records.select("sender", F.coalesce(F.col("ord").cast("long"), F.lit(_LAST)).alias("_o"), F.xxhash64(*tie).alias("_t"), *cols)


def source_counts(records: DataFrame) -> DataFrame:
    """(sender, issues, _o, _t): issues per raw sender string and the
    place of its first record.  Reads and shuffles narrow columns only; both
    aggregates combine map-side, so a hot sender is a row per task."""
    per = keyed(records).groupBy("sender", "_o").agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_t"))
    return per.groupBy("sender").agg(F.sum("_n").alias("issues"), F.min("_o").alias("_first"), F.min_by("_t", "_o").alias("_t")) \
              .withColumnRenamed("_first", "_o")


def ranked_sources(records: DataFrame) -> DataFrame:
    """F2 on the narrow table: rank by count desc, then first appearance."""
    return global_rank(source_counts(records), [F.desc("issues"), F.asc("_o"), F.asc("_t"), F.asc("sender")], "rank",
                       lead=[("issues", False), ("_o", True)])


def issues_per_source(records: DataFrame, narrow: DataFrame | None = None) -> DataFrame:
    """F1 + F2 + F4: ``ranked_sources`` with each sender's first record, one
    row per sender whatever records share or lack ``ord``.  ``narrow`` is the
    same records without bodies, if the caller has them stored.

    The ranked table is written to the shared folder.  The one pass over the
    full records tests a Bloom filter of the first records' places, so about
    one record a sender, with its body, meets the table; the table's real size
    decides whether that is a lookup in memory
    (``spark.sql.autoBroadcastJoinThreshold``) or a join by shuffle.
    """
    g = stored(ranked_sources(records if narrow is None else narrow), "sources")
    chosen = may_hold(g, "sender", "_o", "_t")
    g = g.withColumnsRenamed({"sender": "_s", "_o": "_go", "_t": "_gt"})
    full = keyed(records, F.struct("subject", "date", "body").alias("first")).where(chosen)
    met = full.join(g, F.col("sender").eqNullSafe(F.col("_s")) & (F.col("_o") == F.col("_go")) & (F.col("_t") == F.col("_gt")))
    return met.groupBy("sender", "issues", "rank", "_o").agg(F.min_by("first", F.xxhash64("first")).alias("first")).select(
        "sender", F.when(F.col("_o") != _LAST, F.col("_o")).alias("first_ord"), "issues", "first", "rank")


def source_totals(records: DataFrame) -> DataFrame:
    """F3 from the narrow table: all messages and senders."""
    return source_counts(records).agg(F.sum("issues").alias("n_messages"), F.count(F.lit(1)).alias("n_sources"))


def parse_dates(records: DataFrame) -> DataFrame:
    """C11 on every record (failures only leave the date logic)."""
    return with_parsed_date(records, "date")


def date_extent(parsed: DataFrame) -> DataFrame:
    """earliest/latest instant and their wall clocks in their own offsets.
    Equal instants resolve to list order, like Python's min/max."""
    ok = parsed.where("date_ok")
    return ok.agg(
        F.count(F.lit(1)).alias("n_dated"),
        F.min("ts").alias("earliest_ts"),
        F.max("ts").alias("latest_ts"),
        F.min_by("local_ts", F.struct("ts", "ord")).alias("earliest_local"),
        F.max_by("local_ts", F.struct("ts", -F.col("ord"))).alias("latest_local"),
    )


def range_label(extent: DataFrame, run_ts: dt.datetime, days: int) -> DataFrame:
    """the report's date-range line and the file-name stem."""
    run = F.lit(run_ts).cast("timestamp_ntz")
    run_s = F.date_format(run, "yyyy-MM-dd HH:mm")
    fallback = F.lit(run_ts - dt.timedelta(days=days)).cast("timestamp_ntz")
    has = F.col("n_dated") > 0
    earliest = F.when(has, F.col("earliest_local")).otherwise(fallback)
    label = F.when(has, F.concat(
        F.lit("## "), F.date_format("earliest_local", "MMMM dd"), F.lit(" to "),
        F.date_format("latest_local", "MMMM dd, yyyy, HH:mm"), F.lit(" (summary run at "), run_s, F.lit(")"),
    )).otherwise(F.concat(
        F.lit("## Week of "), F.date_format(fallback, "MMMM dd"), F.lit(" to "),
        F.date_format(run, "MMMM dd, yyyy, HH:mm"), F.lit(" (summary run at "), run_s, F.lit(")"),
    ))
    stem = F.concat(F.date_format(run, "yyyyMMdd_HHmm"), F.lit("_from_"), F.date_format(earliest, "yyyyMMdd"))
    return extent.select("*", label.alias("range_line"), stem.alias("stem"),
                         F.concat(F.lit(cfg.REPORT_FILE_PREFIX), stem, F.lit(".md")).alias("file_name"))


def latest_slice(parsed: DataFrame) -> DataFrame:
    """G1: dated records no older than the newest one minus 1 day.

    The newest instant is an uncorrelated scalar subquery (one partial +
    final aggregate reading only ``ts``); no join, no window.
    """
    ok = parsed.where("date_ok")
    newest = ok.select(F.max("ts")).scalar()
    return ok.where(F.col("ts") >= newest - F.expr("INTERVAL 1 DAY"))


def latest_lines(latest: DataFrame) -> DataFrame:
    """K1: one report line per latest record, flagged when breaking."""
    subj, short = clean_subject(F.col("subject")), short_sender(F.col("sender"))
    hot = is_breaking(F.col("subject"))
    line = F.when(hot, F.concat(F.lit(f"- {cfg.REPORT_HOT_MARK} **"), subj, F.lit("** (via "), short, F.lit(")"))) \
            .otherwise(F.concat(F.lit("- "), subj, F.lit(" (via "), short, F.lit(")")))
    return latest.select("ord", subj.alias("clean_subject"), short.alias("short_sender"),
                         hot.alias("breaking"), line.alias("line"))

