"""End-to-end entry points (summary run, cost report, validation, review)."""

import datetime as dt
import json
import os

from briefkit.plans import summary as P
from briefkit.session import scratch_path
from briefkit.sources import tables as T
from briefkit.sources.costlog import good_rows, read_cost_log
from briefkit.sources.messages import to_message_resources
from briefkit.sources.report_sink import concat_parts

from .conftest import SF


def test_summary_run(spark, tmp_dir):
    src = scratch_path(spark, "t-sum-src")
    to_message_resources(T.messages(spark, SF)).write.json(src)
    reg0 = scratch_path(spark, "t-sum-reg0")
    T.registry(spark, SF).write.parquet(reg0)
    out, log, root = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "costs"), scratch_path(spark, "t-sum-reg")
    p = P.SummaryParams(run_ts=dt.datetime(2024, 1, 31, 9, 30), days=7, batch_items=20, front_matter=True)
    res = P.run_summary(spark, src, out, p, log, root, registry_path=reg0)
    assert res["n_messages"] > 0 and res["n_topics"] > 0
    assert res["file_name"].startswith("message_digest_20240131_0930_from_2024012")
    text = concat_parts(res["report"])
    assert text.startswith("---\nlayout: default\ntitle: Message digest - January 31, 2024\n---\n\n")
    for heading in ("# MESSAGE DIGEST", "## Generated with gpt-4.1-2025-04-14", "## TOP AI DEVELOPMENTS",
                    "## JUST IN: LATEST DEVELOPMENTS", "## NEWSLETTER SOURCES", "## METHODOLOGY"):
        assert heading in text
    n_batches = spark.read.parquet(res["scored"]).count()
    assert good_rows(read_cost_log(spark, log)).count() == n_batches
    assert spark.read.parquet(res["registry"]).count() >= T.registry(spark, SF).count()
    # validation and review read the version that the run has written
    roll, listing = P.run_validation(spark, root)
    assert roll.first().n_errors >= 0 and listing.count() > 0
    before = sorted(map(tuple, spark.read.parquet(res["registry"]).collect()))
    open_ = [r[0] for r in before if not r[2]]
    done = P.run_review(spark, root, spark.createDataFrame([(open_[0], "a", None)], "name string, action string, new_url string"), root)
    assert done["changed"] and done["registry"].rpartition("/")[2] > res["registry"].rpartition("/")[2]
    after = sorted(map(tuple, spark.read.parquet(done["registry"]).collect()))
    assert [r[0] for r in after if not r[2]] == open_[1:]
    # a second run over a window with no messages is a no-op
    p2 = P.SummaryParams(run_ts=dt.datetime(2030, 1, 1), days=1)
    assert P.run_summary(spark, src, out, p2, log, root)["n_messages"] == 0


def test_unknown_provider(spark):
    try:
        P.route(spark, "nope", None)
    except ValueError as e:
        assert "Unknown model provider" in str(e)
    else:
        raise AssertionError("expected ValueError")
    assert P.route(spark, "nope", "my/model")["model"] == "my/model"


def test_cost_validation_review(spark, tmp_dir):
    log = os.path.join(tmp_dir, "log.json")
    with open(log, "w") as f:
        json.dump([{"timestamp": "2024-01-30T00:00:00", "provider": "openai", "model": "m", "total_tokens": 10,
                    "cost": 1.0}], f)
    rows = {r.level: r for r in P.run_cost_report(spark, log, dt.datetime(2024, 2, 1)).collect()}
    assert rows["total"].runs == 1
    reg = os.path.join(tmp_dir, "sites.json")
    with open(reg, "w") as f:
        json.dump({"a": {"url": "https://a.com", "verified": False}, "b": {"url": "bad", "verified": True}}, f)
    roll, listing = P.run_validation(spark, reg)
    assert roll.first().n_errors == 1
    assert [r.line for r in listing.orderBy("line_no").collect()] == ["📁 Newsletter Websites:", "   • Invalid URL for 'b': bad"]
    dec = spark.createDataFrame([("a", "a", None)], "name string, action string, new_url string")
    res = P.run_review(spark, reg, dec, scratch_path(spark, "t-review"))
    assert res["changed"] and res["n_accepted"] == 1
    assert {r.name: r.verified for r in spark.read.parquet(res["registry"]).collect()} == {"a": True, "b": True}


def test_summary_from_stored_table_matches_files(spark, tmp_dir):
    from briefkit.streaming import pipelines as S
    from briefkit.streaming.deliveries import ingest_log_stream
    src = scratch_path(spark, "t-sum2-src")
    to_message_resources(T.messages(spark, SF)).write.json(src)
    table, ck = scratch_path(spark, "t-sum2-table"), scratch_path(spark, "t-sum2-ck")
    S.ingest_stream(spark, src, table, ck).awaitTermination()
    log, ck2 = scratch_path(spark, "t-sum2-log"), scratch_path(spark, "t-sum2-ck2")
    ingest_log_stream(spark, src, log, ck2).awaitTermination()
    p = P.SummaryParams(run_ts=dt.datetime(2024, 1, 31, 9, 30), days=7, batch_items=20)
    texts = []
    for path, stored in ((src, False), (table, True), (log, True)):
        res = P.run_summary(spark, path, os.path.join(tmp_dir, f"o{len(texts)}"), p, os.path.join(tmp_dir, f"c{len(texts)}"),
                            scratch_path(spark, "t-sum2-reg"), stored=stored)
        texts.append(concat_parts(res["report"]))
    assert texts[0] == texts[1] == texts[2]
