"""Bloom filter literal and what it spares the exchange."""

import re

from pyspark.sql import functions as F

from briefkit.operators import bloom, stats


def test_no_key_is_missed_and_few_others_pass(spark):
    df = spark.range(20_000).select(F.when(F.col("id") != 7, F.concat(F.lit("s"), F.col("id").cast("string"))).alias("a"), F.col("id").alias("b"))
    keys = df.where("b % 50 = 7")
    passed = df.where(bloom.may_hold(keys, "a", "b"))
    assert passed.where("b % 50 = 7").count() == 400
    assert passed.count() < 400 + 500
    assert df.where(bloom.may_hold(keys.limit(0), "a", "b")).count() == 0


def test_full_filter_only_lets_more_pass(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", 128)
    df = spark.range(1000)
    assert df.where(bloom.may_hold(df.where("id < 500"), "id")).where("id < 500").count() == 500


def test_one_record_a_sender_reaches_the_exchange(spark):
    """With joins by shuffle, the records that are shuffled with their bodies
    are about as many as there are senders."""
    rec = "ord long, subject string, date string, sender string, body string, body_format string"
    rows = [(i, f"s{i}", "d", f"sender {i % 40} <a@b.c>", "body " * 50, None) for i in range(4000)] + [(None, "x", "d", None, "b", None)]
    df = spark.createDataFrame(rows, rec).repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stats.issues_per_source(df)
        got = {r.sender: (r.first_ord, r.issues, r.first.subject) for r in out.collect()}
        assert got == {f"sender {i} <a@b.c>": (i, 100, f"s{i}") for i in range(40)} | {None: (None, 1, "x")}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the test of the literal stands below the exchange of the join
    body = plan.index("body")
    assert "getbit" in plan or "bit_get" in plan, plan
    assert re.search(r"Exchange hashpartitioning\((?:coalesce\()?sender", plan[:body] + plan), plan
