"""String functions (C6–C10, C12, C13, C17) on hand-written cases."""

from pyspark.sql import functions as F

from briefkit.functions import text as X


def one(spark, col_fn, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(col_fn(F.col("x"))).collect()]


def test_clean_subject(spark):
    got = one(spark, X.clean_subject, ["[Tag] Prefix: Title", "Plain title", "[AI] News: a: b",
                                       "  [x]  y  ", "Breaking: GPT-5 released", None])
    assert got == ["Title", "Plain title", "a: b", "[x]  y", "GPT-5 released", None]


def test_breaking_uses_raw_subject(spark):
    got = one(spark, X.is_breaking, ["[Breaking] x", "OpenAI Launches thing", "quiet week", "Just In: y", None])
    assert got == [True, True, False, True, False]


def test_sender_parse(spark):
    vals = ["Test Newsletter <test@example.com>", "bare@example.com", "<only@addr.com>", "Name   <a@b.c>"]
    names = one(spark, X.sender_name, vals)
    emails = one(spark, X.sender_email, vals)
    assert names == ["Test Newsletter", "bare@example.com", "", "Name"]
    assert emails == ["test@example.com", None, "only@addr.com", "a@b.c"]


def test_short_sender_and_key(spark):
    assert one(spark, X.short_sender, ["The Neuron <a@b.c>", "x@y.z", " Pad <p@q.r>"]) == ["The Neuron", "x@y.z", "Pad"]
    assert one(spark, X.registry_key, ["  The Neuron ", "ABC"]) == ["the neuron", "abc"]


def test_normalize_and_domain(spark):
    assert one(spark, X.normalize, ["Ben's Bites!", "TLDR AI"]) == ["bensbites", "tldrai"]
    assert one(spark, X.email_domain, ["a@mail.example.com", "a@news.x.org", "a@b@newsletter.c.io",
                                       "a@Mail.x.com", "noat"]) == ["example.com", "x.org", "c.io", "Mail.x.com", "noat"]


def test_truncate_always_appends(spark):
    got = one(spark, X.truncate_item, ["short", "é" * 3005])
    assert got[0] == "short..."
    assert got[1] == "é" * 3000 + "..."


def test_py_strip_matches_python(spark):
    vals = ["　a b ", "\x1c x \x1f", "", "  "]
    assert one(spark, X.py_strip, vals) == [v.strip() for v in vals]


def test_py_repr_matches_python(spark):
    vals = ["plain", "it's", "both ' and \"", "tab\there", "back\\slash", "trail "]
    assert one(spark, X.py_repr, vals) == [repr(v) for v in vals]


def test_py_repr_beyond_latin(spark):
    values = ["a b", "﻿x", "​", "é ü 日本", " '", "emoji 😀 ok", "tag \U000e0041", "\"", "plain"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[1] for r in df.select("i", X.py_repr(F.col("v"))).orderBy("i").collect()] == [repr(v) for v in values]


def test_json_repr_is_that_of_the_parsed_value(spark):
    import json

    values = [5, -1.5, True, False, None, "x", "it's", 'say "hi"', "a,b:c true null", [], {}, [1, "two", None, [True, {"k": "v: 1, 2"}]],
              {"a": {"b": [1, 2]}, "c": " \\"}, "tab\there", ["\n"]]
    df = spark.createDataFrame([(i, json.dumps(v, separators=(",", ":"))) for i, v in enumerate(values)], "i int, v string")
    assert [r[1] for r in df.select("i", X.json_repr(F.col("v"))).orderBy("i").collect()] == [repr(v) for v in values]
