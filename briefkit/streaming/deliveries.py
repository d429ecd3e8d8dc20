"""S1 and S2 with nothing lost: quarantine, resent messages, late rows.

Both write every micro-batch as one commit (``sources.commitlog``) that holds
all of its outputs, so they appear together and a replayed micro-batch does
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config as cfg
from .. import schemas
from ..functions.markdown import clean_markdown
from ..session import remove, scratch_path, stored
from ..sources import commitlog

MESSAGES = ("msg_id string, ord long, labels array<string>, subject string, date string, sender string, recipient string, body string, "
            "body_format string, cleaned string, received_ts timestamp, received_date date")
QUARANTINE = "msg_id string, received_ts timestamp, raw string, reason string"
WINDOWS = "window_start timestamp, level string, key string, runs long, tokens long, cost double"
LATE = "timestamp string, model string, provider string, prompt_tokens long, completion_tokens long, total_tokens long, cost double, reason string"


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint_dir: str, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


# ------------------------------------------------------------------ messages
def ingest_log_stream(spark: SparkSession, source_dir: str, root: str, checkpoint_dir: str, max_files_per_trigger: int | None = None,
                      available_now: bool = True, clean: Callable[..., Column] = clean_markdown) -> StreamingQuery:
    """Message files → parsed, cleaned messages, and the quarantine.

    A line that is no message, has no id, or whose body cannot be decoded goes
    to the quarantine with its reason and text.  A message that was sent again
    (same id and receipt time) is taken once: copies in a batch by an
    aggregate, copies of earlier batches by an anti-join on the ids stored for
    the batch's receipt dates, the only partitions that are read."""
    from .pipelines import stream_records

    m = stream_records(spark, source_dir, max_files_per_trigger, raw=True)
    received = F.timestamp_millis("internalDate")
    reason = F.when(F.col("raw_line").isNotNull(), "not a message").when(F.col("msg_id").isNull(), "no id").when(~F.col("decode_ok"), "undecodable body")
    m = m.select("*", received.alias("received_ts"), F.to_date(received).alias("received_date"), reason.alias("reason"))

    def write(batch: DataFrame, batch_id: int) -> None:
        if commitlog.applied(spark, root, batch_id):
            return
        held = scratch_path(spark, "s1-batch")   # the parsed lines, until the batch is committed
        batch.write.option("compression", "zstd").parquet(held)
        x = spark.read.schema(batch.schema).parquet(held)
        path = commitlog.batch_path(root, name := commitlog.new_batch())
        good = x.where("reason is null").drop("raw_line", "raw_message", "reason", "decode_ok")
        dates = [r[0] for r in good.select("received_date").distinct().collect()]   # the days of one batch
        seen = commitlog.read(spark, root, MESSAGES, "messages")
        days = F.col("received_date").isin([d for d in dates if d]) | (F.col("received_date").isNull() if None in dates else F.lit(False))
        seen = seen.where(days).select("msg_id", "received_ts")
        same = (good["msg_id"] == seen["msg_id"]) & good["received_ts"].eqNullSafe(seen["received_ts"])
        fresh = good.join(seen, same, "left_anti").dropDuplicates(["msg_id", "received_ts"])
        cols = [c.strip().split()[0] for c in MESSAGES.split(", ")]
        # written where the copies met: bodies go over the network once
        fresh = fresh.withColumn("cleaned", clean(F.col("body")))
        fresh.select(*cols).write.option("compression", "zstd").partitionBy("received_date").parquet(f"{path}/messages")
        bad = F.coalesce("raw_line", "raw_message", F.to_json(F.struct("msg_id", "subject", "date", "sender", "recipient", "body_format")))
        x.where("reason is not null").select("msg_id", "received_ts", bad.alias("raw"), "reason").write.parquet(f"{path}/quarantine")
        commitlog.commit(spark, root, name, mark=batch_id)
        remove(spark, held)

    return _run(m, write, checkpoint_dir, available_now)


def read_messages_log(spark: SparkSession, root: str) -> DataFrame:
    """The messages taken so far; a filter on ``received_date`` prunes."""
    return commitlog.read(spark, root, MESSAGES, "messages").drop("_rank").withColumn("decode_ok", F.lit(True))


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return commitlog.read(spark, root, QUARANTINE, "quarantine").drop("_rank")


# --------------------------------------------------------------------- costs
def cost_levels_stream(spark: SparkSession, source_dir: str, root: str, checkpoint_dir: str, delay_hours: int = 24,
                       max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Daily windows per provider and per model, and the rows behind.

    The watermark is the newest time of all earlier micro-batches less
    ``delay_hours``, carried in the commits.  A row whose window had ended by
    then, or whose time does not parse, is kept in the late table with its
    reason; all others are summed per window, level and key.  A window is the
    sum of its micro-batches' rows, so no state is held and windows and late
    rows add up to the log."""
    reader = spark.readStream.schema(schemas.COST)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        if commitlog.applied(spark, root, batch_id):
            return
        high = max((c.high for c in commitlog.commits(spark, root) if c.high is not None), default=None)
        x = stored(batch.withColumn("_ts", F.try_to_timestamp("timestamp")), "s2-batch")
        start = F.date_trunc("day", "_ts")
        ended = F.unix_micros(start + F.expr("INTERVAL 1 DAY")) <= F.lit((high or 0) - delay_hours * 3_600_000_000) if high is not None else F.lit(False)
        reason = F.when(F.col("_ts").isNull(), "no time").when(ended, "late")
        x = x.withColumn("reason", reason)
        path = commitlog.batch_path(root, name := commitlog.new_batch())
        unknown = F.lit(cfg.UNKNOWN_KEY)
        both = F.array(F.struct(F.lit("provider").alias("level"), F.coalesce("provider", unknown).alias("key")),
                       F.struct(F.lit("model").alias("level"), F.coalesce("model", unknown).alias("key")))
        rows = x.where("reason is null").select(start.alias("window_start"), F.explode(both).alias("k"), F.coalesce("total_tokens", F.lit(0)).alias("tokens"),
                                                F.coalesce("cost", F.lit(0.0)).alias("cost"))
        rows.groupBy("window_start", "k.level", "k.key").agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")) \
            .write.parquet(f"{path}/windows")
        x.where("reason is not null").drop("_ts").write.parquet(f"{path}/late")
        newest = x.where("reason is null").agg(F.unix_micros(F.max("_ts"))).first()[0]
        commitlog.commit(spark, root, name, mark=batch_id, high=max([h for h in (high, newest) if h is not None], default=None))

    return _run(reader.json(source_dir), write, checkpoint_dir, available_now)


def read_cost_levels(spark: SparkSession, root: str) -> DataFrame:
    """(window_start, level, key, runs, tokens, cost) over all micro-batches."""
    d = commitlog.read(spark, root, WINDOWS, "windows")
    return d.groupBy("window_start", "level", "key").agg(F.sum("runs").alias("runs"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """The rows in no window, with their reason."""
    return commitlog.read(spark, root, LATE, "late").drop("_rank")
