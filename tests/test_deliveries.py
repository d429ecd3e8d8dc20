"""S1 with quarantine and resent messages, S2 by level with late rows, S3 as
deltas: over several micro-batches, replayed and recovered."""

import json
import os

from pyspark.sql import functions as F

from briefkit.operators import sites, stats
from briefkit.session import scratch_path
from briefkit.sources import commitlog
from briefkit.sources import tables as T
from briefkit.sources.messages import read_messages, to_message_resources
from briefkit.streaming import deliveries as D
from briefkit.streaming import pipelines as S

from .conftest import SF


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def msg(id_, ms, data="aGk="):
    return {"id": id_, "internalDate": ms, "payload": {"headers": [{"name": "Subject", "value": id_ or ""}], "body": {"data": data}}}


DAY = 86_400_000


def test_quarantine_and_resent_messages(spark, tmp_dir):
    src, root, ck = os.path.join(tmp_dir, "in"), scratch_path(spark, "t-log"), scratch_path(spark, "t-ck")
    put(src, "a.json", [msg("a", DAY), msg("a", DAY), msg("b", 2 * DAY, "%%"), "{broken", msg(None, DAY), msg("n", None)])
    D.ingest_log_stream(spark, src, root, ck).awaitTermination()
    put(src, "b.json", [msg("a", DAY), msg("a", 3 * DAY), msg("c", DAY, "PGI-Ym9sZDwvYj4"), "also broken", msg("n", None), msg("b", 2 * DAY)])
    D.ingest_log_stream(spark, src, root, ck).awaitTermination()
    got = sorted((r.msg_id, r.ord, r.cleaned) for r in D.read_messages_log(spark, root).collect() if r.ord is not None)
    assert got == [("a", DAY, "hi"), ("a", 3 * DAY, "hi"), ("b", 2 * DAY, "hi"), ("c", DAY, "**bold**")]
    assert D.read_messages_log(spark, root).where("msg_id = 'n'").count() == 1
    bad = {(r.msg_id, r.reason): r.raw for r in D.read_quarantine(spark, root).collect()}
    assert set(bad) == {("b", "undecodable body"), (None, "not a message"), (None, "no id")}
    assert '"%%"' in bad[("b", "undecodable body")]
    assert sorted(r.raw for r in D.read_quarantine(spark, root).where("reason = 'not a message'").collect()) == ["also broken", "{broken"]
    assert len(commitlog.commits(spark, root)) == 2


def test_a_replayed_batch_changes_nothing(spark, tmp_dir):
    """The checkpoint is lost, the log is not: the same batches come again."""
    src, root = os.path.join(tmp_dir, "in"), scratch_path(spark, "t-log")
    put(src, "a.json", [msg("a", DAY), "x"])
    for _ in range(2):
        D.ingest_log_stream(spark, src, root, scratch_path(spark, "t-ck")).awaitTermination()
    assert D.read_messages_log(spark, root).count() == 1 and D.read_quarantine(spark, root).count() == 1


def cost(ts, provider="p", model="m", c=1.0):
    return {"timestamp": ts, "provider": provider, "model": model, "total_tokens": 10, "cost": c}


def test_levels_and_late_rows_add_up(spark, tmp_dir):
    src, root, ck = os.path.join(tmp_dir, "in"), scratch_path(spark, "t-log"), scratch_path(spark, "t-ck")
    parts = [[cost("2024-01-10T10:00:00"), cost("2024-01-12T10:00:00", None, "n", 2.0)],
             [cost("2024-01-01T10:00:00", c=100.0), cost("2024-01-12T11:00:00", c=4.0), cost("soon"), cost(None)],
             [cost("2024-01-11T23:00:00", c=8.0), cost("2024-01-10T23:00:00", c=16.0)]]
    for i, p in enumerate(parts):
        put(src, f"{i}.json", p)
        D.cost_levels_stream(spark, src, root, ck).awaitTermination()
    w = {(str(r.window_start)[:10], r.level, r.key): (r.runs, r.cost) for r in D.read_cost_levels(spark, root).collect()}
    assert w == {("2024-01-10", "provider", "p"): (1, 1.0), ("2024-01-10", "model", "m"): (1, 1.0), ("2024-01-11", "provider", "p"): (1, 8.0),
                 ("2024-01-11", "model", "m"): (1, 8.0), ("2024-01-12", "provider", "unknown"): (1, 2.0), ("2024-01-12", "model", "n"): (1, 2.0),
                 ("2024-01-12", "provider", "p"): (1, 4.0), ("2024-01-12", "model", "m"): (1, 4.0)}
    late = sorted((r.reason, r.cost) for r in D.read_late(spark, root).collect())
    assert late == [("late", 16.0), ("late", 100.0), ("no time", 1.0), ("no time", 1.0)]
    for level in ("provider", "model"):
        assert sum(v[1] for k, v in w.items() if k[1] == level) + sum(c for _, c in late) == sum(x["cost"] for p in parts for x in p)


def batch_registry(spark, src, initial, cur):
    recs = read_messages(spark, src).withColumn("ord", F.col("internalDate")).select("ord", "subject", "date", "sender", "body", "body_format")
    return sorted(map(tuple, sites.merge_registry(initial, sites.resolve_homepages(stats.issues_per_source(recs), initial, cur)).collect()))


def test_registry_over_many_batches_is_the_batch_result(spark):
    src, root, first = scratch_path(spark, "t-s3"), scratch_path(spark, "t-s3-reg"), scratch_path(spark, "t-s3-first")
    to_message_resources(T.messages(spark, SF)).repartition(6, "id").write.json(src)
    T.registry(spark, SF).write.parquet(first)
    initial, cur = spark.read.parquet(first), T.curated(spark, SF)
    S.registry_stream(spark, src, root, scratch_path(spark, "t-ck"), curated=cur, initial=first, max_files_per_trigger=1, compact_every=3).awaitTermination()
    assert sorted(map(tuple, S.latest_registry(spark, root).collect())) == batch_registry(spark, src, initial, cur)
    live = commitlog.commits(spark, root)
    assert live[0].upto is not None and len(live) <= 4


def sender(name, day, body="see https://ok.example.com/"):
    return {"id": f"{name}{day}", "internalDate": day * DAY, "payload": {"headers": [{"name": "From", "value": name}], "body": {"data": body}}}


def test_rank_is_carried_across_batches(spark, tmp_dir):
    """Two senders share a key: the one with fewer issues in all wins, not the
    one of the last batch; other keys are not written again."""
    src, root = os.path.join(tmp_dir, "in"), scratch_path(spark, "t-s3-reg")
    a, b = "Some Paper <x@one.org>", "some paper <x@somepaper.org>"
    link = "c2VlIGh0dHBzOi8vb2suZXhhbXBsZS5jb20v"   # see https://ok.example.com/
    batches = [[sender(a, 1, link), sender(a, 2, link), sender("Else <e@else.org>", 1, link)], [sender(b, 3, link)], [sender(a, 4, link), sender(b, 5, link), sender(b, 6, link), sender(b, 7, link)]]
    ck, want = scratch_path(spark, "t-ck"), ["https://ok.example.com/", "https://somepaper.org", "https://ok.example.com/"]
    for i, (lines, url) in enumerate(zip(batches, want)):
        put(src, f"{i}.json", lines)
        S.registry_stream(spark, src, root, ck).awaitTermination()
        assert {r.name: r.url for r in S.latest_registry(spark, root).collect()}["some paper"] == url, i
    assert batch_registry(spark, src, None, sites.curated_sites(spark)) == sorted(map(tuple, S.latest_registry(spark, root).collect()))
    last = commitlog.commits(spark, root)[-1]
    written = spark.read.parquet(commitlog.batch_path(root, last.batch) + "/entries")
    assert [r.name for r in written.collect()] == ["some paper"]


def test_stream_sources_are_many_files(spark):
    """No task gathers a quarter of the messages into one file; there are four
    micro-batches all the same, and no parsed batch stays behind."""
    from briefkit.plans import catalog
    from briefkit.session import children, ensure_checkpoint_dir
    for src in (catalog._stream_source(spark, SF), catalog._resent(spark, SF)):
        files = [n for n in children(spark, src) if n.startswith("part-")]
        assert len(files) >= 32 and len(files) <= 4 * catalog._per_trigger(spark, src)
        sizes = spark.read.text(src).groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[0] <= sizes[1] / 16
    kept = f"{ensure_checkpoint_dir(spark)}/briefkit"
    before = {n for n in children(spark, kept) if n.startswith("s1-batch")}
    assert catalog.stream_quarantine(spark, SF).count() > 0
    assert {n for n in children(spark, kept) if n.startswith("s1-batch")} == before
