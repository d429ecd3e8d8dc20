"""Structured Streaming deliveries of the batch operators.

Every stream writes its checkpoint and output under the shared folder
named by ``spark.checkpoint.dir`` (``session.scratch_path``); sinks are
idempotent per micro-batch (a replayed batch rewrites the same folder).

* S1 ``ingest_stream``   — message files → parse (C1–C5) → clean (D) → Parquet.
* S2 ``cost_stream``     — cost rows → daily windows per provider with a
  watermark for late rows; each micro-batch's updated windows are written
  to their own folder, and ``read_cost_windows`` keeps the newest value.
* S3 ``registry_stream`` — per micro-batch homepage resolution (H3–H5) of the
  keys it touches, as deltas (``registry_state``).

``deliveries`` has S1 with a quarantine and resent messages, and S2 by provider
and model with the late rows kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config as cfg
from .. import schemas
from ..functions.markdown import clean_markdown
from ..operators import sites
from ..operators.parse import parse_messages
from . import registry_state


def _trigger(w, available_now: bool):
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")


def stream_records(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None, raw: bool = False) -> DataFrame:
    """A1 + C1–C5 on a stream of exported message files.  ``ord`` is the
    server receipt time (``internalDate``), the list order of a mailbox;
    ``raw`` as in ``parse_messages``."""
    r = spark.readStream.schema(schemas.MESSAGE_LINE)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    m = parse_messages(r.json(source_dir), raw)
    return m.withColumn("ord", F.col("internalDate"))


def ingest_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  max_files_per_trigger: int | None = None, available_now: bool = True, clean: Callable[..., Column] = clean_markdown) -> StreamingQuery:
    """Parsed records with their cleaned text appended to Parquet,
    partitioned by the receipt date so a look-back (B1) on ``received_ts``
    prunes whole partitions.  The cleaned text is computed once here and
    reused by every later summary window.  Rows flagged by ``decode_ok``
    stay for quarantine."""
    m = stream_records(spark, source_dir, max_files_per_trigger)
    received = F.timestamp_millis("internalDate")
    out = m.select("msg_id", "ord", "labels", "subject", "date", "sender", "recipient", "body", "body_format",
                   "decode_ok", F.md5("body").alias("body_md5"), clean(F.col("body")).alias("cleaned"),
                   received.alias("received_ts"), F.to_date(received).alias("received_date"))
    w = out.writeStream.format("parquet").option("compression", "zstd").partitionBy("received_date").option("path", sink_dir) \
           .option("checkpointLocation", checkpoint_dir)
    return _trigger(w, available_now).start()


def cost_windows(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """S2 plan: daily windows per provider, late rows bounded by the watermark.
    The event-time column must be TIMESTAMP (not NTZ) for the watermark.  Rows
    whose time does not parse are in no window: ``untimed`` has them."""
    s = stream.withColumn("event_ts", F.try_to_timestamp(F.col("timestamp"))).withWatermark("event_ts", watermark)
    return s.groupBy(F.window("event_ts", "1 day").alias("w"),
                     F.coalesce("provider", F.lit(cfg.UNKNOWN_KEY)).alias("provider")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))


def untimed(costs: DataFrame) -> DataFrame:
    """Quarantine of S2: cost rows whose time is missing or does not parse."""
    return costs.where(F.try_to_timestamp(F.col("timestamp")).isNull())


def cost_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                watermark: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Run ``cost_windows`` in update mode; batch k's updates go to
    ``sink_dir/batch_id=k`` (overwritten on replay)."""
    agg = cost_windows(spark.readStream.schema(schemas.COST).json(source_dir), watermark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("w.start").alias("window_start"), "provider", "runs", "tokens", "cost") \
             .write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    w = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    return _trigger(w, available_now).start()


def read_cost_windows(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Newest value of every (window, provider) across micro-batches."""
    d = spark.read.parquet(sink_dir)
    return d.groupBy("window_start", "provider").agg(
        F.max_by(F.struct("runs", "tokens", "cost"), "batch_id").alias("v")).select(
        "window_start", "provider", "v.runs", "v.tokens", "v.cost")


def registry_stream(spark: SparkSession, source_dir: str, registry_root: str, checkpoint_dir: str,
                    curated: DataFrame | None = None, initial: str | None = None, available_now: bool = True,
                    max_files_per_trigger: int | None = None, compact_every: int = registry_state.COMPACT_EVERY) -> StreamingQuery:
    """S3: every micro-batch updates the keys of its senders
    (``registry_state``).  After any number of batches the registry is what
    the batch operators give for all messages together."""
    m = stream_records(spark, source_dir, max_files_per_trigger)
    cur = curated if curated is not None else sites.curated_sites(spark)
    registry_state.start(spark, registry_root, spark.read.parquet(initial) if initial else None)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        records = batch.select("ord", "subject", "date", "sender", "body", "body_format")
        registry_state.upsert(spark, registry_root, records, cur, batch_id, compact_every)

    w = m.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint_dir)
    return _trigger(w, available_now).start()


def latest_registry(spark: SparkSession, registry_root: str) -> DataFrame:
    return registry_state.read_state(spark, registry_root)
