"""Ordered, partitioned cost log (A4, F12) and its commits."""

import datetime as dt
import json
import os
import re
import threading

import pytest

from briefkit.operators import costs
from briefkit.operators.select import cost_lookback
from briefkit.session import scratch_path
from briefkit.sources import commitlog
from briefkit.sources.costlog import append_cost_rows, compact_cost_log, good_rows, import_cost_log, read_cost_log

COST = "timestamp string, model string, provider string, prompt_tokens long, completion_tokens long, total_tokens long, cost double"


def batch(spark, *rows):
    return spark.createDataFrame([(t, "m", p, 1, 2, 3, 0.5) for t, p in rows], COST).coalesce(1)


def providers(spark, root):
    log = good_rows(read_cost_log(spark, root))
    return [r.provider for r in log.orderBy("ord").collect()]


def test_group_order_is_append_order(spark):
    root = scratch_path(spark, "t-log")
    assert append_cost_rows(batch(spark, ("2024-01-09T00:00:00", "z"), ("2024-01-01T00:00:00", "y")), root) == 1
    assert append_cost_rows(batch(spark, ("2024-01-05T00:00:00", "a"), ("2024-01-01T00:00:00", "z")), root) == 2
    assert append_cost_rows(batch(spark, (None, "q"), ("soon", "b")), root) == 3
    assert providers(spark, root) == ["z", "y", "a", "z", "q", "b"]
    g = costs.cost_rollup(good_rows(read_cost_log(spark, root)), dt.datetime(2024, 2, 1), 0)
    assert [r.key for r in g.where("level = 'provider'").orderBy("first_ord").collect()] == ["z", "y", "a", "q", "b"]
    compact_cost_log(spark, root)
    append_cost_rows(batch(spark, ("2024-01-01T00:00:00", "c")), root)
    assert providers(spark, root) == ["z", "y", "a", "z", "q", "b", "c"]
    assert [c.upto for c in commitlog.commits(spark, root)] == [3, None]
    assert commitlog.vacuum(spark, root) == 3
    assert providers(spark, root) == ["z", "y", "a", "z", "q", "b", "c"]
    compact_cost_log(spark, root)
    assert providers(spark, root) == ["z", "y", "a", "z", "q", "b", "c"]


def test_lookback_reads_its_days_only(spark):
    root = scratch_path(spark, "t-log")
    days = [dt.date(2023, 11, 1) + dt.timedelta(days=i) for i in range(90)]
    append_cost_rows(batch(spark, *[(f"{d}T12:00:00", "p") for d in days], (None, "none"), ("zz", "odd")), root)
    log = good_rows(read_cost_log(spark, root))
    seen = cost_lookback(log, dt.datetime(2024, 1, 29, 13), 30)
    plan = re.sub(r"#\d+", "", seen._jdf.queryExecution().executedPlan().toString())
    assert re.search(r"PartitionFilters: \[[^\]]*day >= 2023-12-30", plan), plan
    # the original compares the texts: 'zz' is after any time, none before
    assert sorted(r.provider for r in seen.collect()) == ["odd"] + ["p"] * 30
    assert cost_lookback(log, dt.datetime(2024, 1, 29), 0).count() == 92


def test_writers_at_once_get_numbers_of_their_own(spark):
    root, errors = scratch_path(spark, "t-log"), []

    def write(k):
        try:
            append_cost_rows(batch(spark, (f"2024-01-0{k + 1}T00:00:00", f"p{k}")), root)
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert [c.seq for c in commitlog.commits(spark, root)] == [1, 2, 3, 4, 5, 6]
    assert sorted(providers(spark, root)) == [f"p{k}" for k in range(6)]


def test_a_folder_without_commit_is_not_read(spark):
    root = scratch_path(spark, "t-log")
    append_cost_rows(batch(spark, ("2024-01-01T00:00:00", "a")), root)
    batch(spark, ("2024-01-01T00:00:00", "lost")).selectExpr("*", "1L as pos", "null as seq", "date'2024-01-01' as day") \
        .write.partitionBy("day").parquet(commitlog.batch_path(root, commitlog.new_batch()))
    assert providers(spark, root) == ["a"]


def test_many_appends_are_compacted(spark):
    root = scratch_path(spark, "t-log")
    for k in range(4):
        append_cost_rows(batch(spark, ("2024-01-01T00:00:00", f"p{k}")), root, compact_every=2)
    assert providers(spark, root) == [f"p{k}" for k in range(4)]
    assert len(commitlog.commits(spark, root)) <= 3


def test_import_of_the_original_form(spark, tmp_dir):
    old, root = os.path.join(tmp_dir, "old.json"), scratch_path(spark, "t-log")
    with open(old, "w") as f:
        json.dump([{"timestamp": "2024-01-02T00:00:00", "provider": "b", "cost": 1.0}, {"timestamp": "2024-01-01T00:00:00", "provider": "a"}], f)
    with pytest.raises(ValueError):
        append_cost_rows(batch(spark, ("2024-01-01T00:00:00", "x")), old)
    import_cost_log(spark, old, root)
    append_cost_rows(batch(spark, ("2024-01-01T00:00:00", "x")), root)
    assert providers(spark, root) == ["b", "a", "x"]
