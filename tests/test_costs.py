"""Cost log scan, look-back and roll-up."""

import datetime as dt
import json
import os

from briefkit.operators import costs
from briefkit.sources.costlog import append_cost_rows, corrupt_rows, good_rows, read_cost_log

AS_OF = dt.datetime(2024, 2, 1, 12, 0)


def write(tmp_dir, text, name="log.json"):
    p = os.path.join(tmp_dir, name)
    with open(p, "w") as f:
        f.write(text)
    return p


LOG = [
    {"timestamp": "2024-01-30T10:00:00", "model": "m1", "provider": "openai", "prompt_tokens": 10,
     "completion_tokens": 5, "total_tokens": 15, "cost": 0.5},
    {"timestamp": "2024-01-31T10:00:00", "model": "m2", "provider": "claude", "total_tokens": 0, "cost": 1.5},
    {"timestamp": "2024-01-31T11:00:00", "cost": 2.0},
    {"model": "m1", "provider": "openai", "total_tokens": 100, "cost": 9.0},
    {"timestamp": "2023-12-01T00:00:00", "model": "m1", "provider": "openai", "total_tokens": 7, "cost": 7.0},
]


def test_scan_missing_keys_and_missing_file(spark, tmp_dir):
    log = good_rows(read_cost_log(spark, write(tmp_dir, json.dumps(LOG))))
    assert log.count() == 5
    assert read_cost_log(spark, os.path.join(tmp_dir, "absent.json")).count() == 0


def test_corrupt_file_is_quarantined(spark, tmp_dir):
    log = read_cost_log(spark, write(tmp_dir, '[{"cost": 1.0}, {broken'))
    assert good_rows(log).count() == 0
    assert corrupt_rows(log).count() == 1


def rollup(spark, tmp_dir, days):
    log = good_rows(read_cost_log(spark, write(tmp_dir, json.dumps(LOG))))
    return {(r.level, r.key): r for r in costs.cost_shares(costs.cost_rollup(log, AS_OF, days)).collect()}


def test_rollup_30_days(spark, tmp_dir):
    r = rollup(spark, tmp_dir, 30)
    tot = r[("total", None)]
    assert (tot.runs, tot.tokens, round(tot.cost, 6)) == (3, 15, 4.0)   # missing timestamp = '' → excluded
    assert round(tot.avg_cost_per_run, 6) == round(4.0 / 3, 6)
    assert r[("provider", "unknown")].runs == 1 and r[("model", "unknown")].runs == 1
    p = r[("provider", "openai")]
    assert round(p.pct_cost, 6) == 12.5 and round(p.pct_runs, 6) == round(100 / 3, 6) and p.pct_tokens == 100.0
    assert round(p.cost_per_1k, 6) == round(0.5 / 15 * 1000, 6)
    assert r[("provider", "claude")].cost_per_1k is None   # zero tokens: no per-1k rate
    assert r[("model", "m1")].pct_runs is None              # run/token shares are provider-only


def test_days_zero_means_no_filter(spark, tmp_dir):
    r = rollup(spark, tmp_dir, 0)
    assert r[("total", None)].runs == 5


def test_append_then_read(spark, tmp_dir):
    p = os.path.join(tmp_dir, "appended")
    rows = spark.createDataFrame([("2024-01-01T00:00:00", "m", "p", 1, 2, 3, 0.1)],
                                 "timestamp string, model string, provider string, prompt_tokens long, "
                                 "completion_tokens long, total_tokens long, cost double")
    append_cost_rows(rows, p)
    append_cost_rows(rows, p)
    assert good_rows(read_cost_log(spark, p)).count() == 2
