"""Streaming deliveries (S1–S3): batch = stream, watermark bounds late rows."""

import json
import os

from briefkit.operators.parse import parse_messages
from briefkit.session import scratch_path
from briefkit.sources import tables as T
from briefkit.sources.messages import to_message_resources
from briefkit.streaming import pipelines as S

from .conftest import SF


def test_ingest_equals_batch(spark):
    src, sink, ck = scratch_path(spark, "t-s1-src"), scratch_path(spark, "t-s1-out"), scratch_path(spark, "t-s1-ck")
    to_message_resources(T.messages(spark, SF)).repartition(3, "id").write.json(src)
    S.ingest_stream(spark, src, sink, ck, max_files_per_trigger=1).awaitTermination()
    streamed = sorted((r.msg_id, r.subject, r.body_format) for r in spark.read.parquet(sink).collect())
    batch = parse_messages(spark.read.schema(__import__("briefkit.schemas", fromlist=["MESSAGE"]).MESSAGE).json(src))
    assert streamed == sorted((r.msg_id, r.subject, r.body_format) for r in batch.collect())


def _write(dirpath, name, rows):
    os.makedirs(dirpath, exist_ok=True)
    with open(os.path.join(dirpath, name), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


def test_cost_windows_watermark(spark, tmp_dir):
    src = os.path.join(tmp_dir, "costs")
    sink, ck = scratch_path(spark, "t-s2-out"), scratch_path(spark, "t-s2-ck")
    row = lambda ts, p, c: {"timestamp": ts, "provider": p, "total_tokens": 10, "cost": c}
    _write(src, "a.json", [row("2024-01-10T10:00:00", "openai", 1.0), row("2024-01-12T10:00:00", "openai", 2.0)])
    S.cost_stream(spark, src, sink, ck).awaitTermination()
    _write(src, "b.json", [row("2024-01-01T10:00:00", "openai", 100.0),   # later than the 1-day watermark
                           row("2024-01-12T11:00:00", None, 4.0), row("2024-01-12T12:00:00", "openai", 3.0)])
    S.cost_stream(spark, src, sink, ck).awaitTermination()
    got = {(str(r.window_start)[:10], r.provider): (r.runs, r.cost) for r in S.read_cost_windows(spark, sink).collect()}
    assert got == {("2024-01-10", "openai"): (1, 1.0), ("2024-01-12", "openai"): (2, 5.0),
                   ("2024-01-12", "unknown"): (1, 4.0)}


def test_registry_stream_replay_is_idempotent(spark):
    src = scratch_path(spark, "t-s3-src")
    to_message_resources(T.messages(spark, SF)).write.json(src)
    out = []
    for _ in range(2):
        root, ck = scratch_path(spark, "t-s3-reg"), scratch_path(spark, "t-s3-ck")
        S.registry_stream(spark, src, root, ck).awaitTermination()
        out.append(sorted(S.latest_registry(spark, root).collect()))
    assert out[0] == out[1] and len(out[0]) > 0


def test_ingested_messages_prune_by_date(spark):
    import datetime as dt
    from briefkit.operators.select import select_messages
    src, sink, ck = scratch_path(spark, "t-s1p-src"), scratch_path(spark, "t-s1p-out"), scratch_path(spark, "t-s1p-ck")
    to_message_resources(T.messages(spark, SF)).write.json(src)
    S.ingest_stream(spark, src, sink, ck).awaitTermination()
    stored = spark.read.parquet(sink)
    sel = select_messages(stored, as_of=dt.datetime(2024, 1, 31), days=3, date_col="received_date")
    import re
    plan = re.sub(r"#\d+", "", sel._jdf.queryExecution().executedPlan().toString())
    assert re.search(r"PartitionFilters: \[[^\]]*received_date >= 2024-01-28", plan), plan
    n_all = stored.where("received_ts >= timestamp'2024-01-28 00:00:00'").count()
    assert sel.count() == n_all > 0


def test_stream_files_and_sink_are_compressed(spark):
    from pyspark.sql import functions as F
    from briefkit.plans import catalog
    from briefkit.session import children
    msgs = T.messages(spark, SF).where("ord < 300")
    src, sink, ck = scratch_path(spark, "t-s1z-src"), scratch_path(spark, "t-s1z-out"), scratch_path(spark, "t-s1z-ck")
    catalog._files(to_message_resources(msgs), spark, SF, "json", src)
    assert all(n.endswith(".json.gz") for n in children(spark, src) if n.startswith("part-"))
    S.ingest_stream(spark, src, sink, ck).awaitTermination()
    got = spark.read.parquet(sink).withColumn("file", F.input_file_name())
    assert got.count() == 300 and got.where("file not like '%.zstd.parquet'").count() == 0
