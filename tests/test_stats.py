"""Per-source statistics, date extent, latest slice."""

import datetime as dt

from briefkit.operators import stats

REC = "ord long, subject string, date string, sender string, body string, body_format string"


def recs(spark, rows):
    return spark.createDataFrame([(i,) + tuple(r) + (None,) for i, r in enumerate(rows)], REC)


def test_rank_and_representative(spark):
    df = recs(spark, [
        ("s1", "Mon, 01 Jan 2024 10:00:00 +0000", "B <b@x.com>", "b1"),
        ("s2", "Mon, 01 Jan 2024 11:00:00 +0000", "A <a@x.com>", "a1"),
        ("s3", "Mon, 01 Jan 2024 12:00:00 +0000", "A <a@x.com>", "a2"),
        ("s4", "Mon, 01 Jan 2024 13:00:00 +0000", "C <c@x.com>", "c1"),
        ("s5", "Mon, 01 Jan 2024 14:00:00 +0000", "B <b@x.com>", "b2"),
        ("s6", "Mon, 01 Jan 2024 15:00:00 +0000", "D", "d1"),
    ])
    out = {r.sender: r for r in stats.issues_per_source(df).collect()}
    # B and A tie on 2: B appeared first.  C before D by first appearance.
    assert [s for s, _ in sorted(((r.sender, r.rank) for r in out.values()), key=lambda x: x[1])] == \
        ["B <b@x.com>", "A <a@x.com>", "C <c@x.com>", "D"]
    assert out["A <a@x.com>"].first.body == "a1" and out["A <a@x.com>"].issues == 2
    t = stats.source_totals(df).first()
    assert (t.n_messages, t.n_sources) == (6, 4)


def test_latest_is_relative_to_newest(spark):
    df = recs(spark, [
        ("[AI] Weekly: Old", "Mon, 01 Jan 2024 10:00:00 +0000", "Old <o@x.com>", ""),
        ("[AI] News: OpenAI launches X", "Wed, 10 Jan 2024 09:00:00 +0000", "N <n@x.com>", ""),
        ("Quiet: Nothing", "Thu, 11 Jan 2024 08:00:00 +0100", "Q <q@x.com>", ""),
        ("Bad", "Invalid date format", "Z <z@x.com>", ""),
    ])
    lines = sorted((r.ord, r.line) for r in stats.latest_lines(stats.latest_slice(stats.parse_dates(df))).collect())
    assert lines == [(1, "- 🔥 **OpenAI launches X** (via N)"), (2, "- Nothing (via Q)")]


def test_extent_and_label_keep_own_offset(spark):
    df = recs(spark, [("a", "Mon, 01 Jan 2024 23:30:00 -0500", "A", ""),
                      ("b", "Tue, 02 Jan 2024 06:00:00 +0200", "B", "")])
    e = stats.range_label(stats.date_extent(stats.parse_dates(df)), dt.datetime(2024, 1, 3, 8, 5), 7).first()
    # In UTC b (04:00) precedes a (04:30); each is shown in its own offset.
    assert e.range_line == "## January 02 to January 01, 2024, 23:30 (summary run at 2024-01-03 08:05)"
    assert e.stem == "20240103_0805_from_20240102"


def test_no_parsable_dates_falls_back(spark):
    df = recs(spark, [("a", "nope", "A", ""), ("b", "2024-01-01", "B", "")])
    p = stats.parse_dates(df)
    assert stats.latest_slice(p).count() == 0
    e = stats.range_label(stats.date_extent(p), dt.datetime(2024, 1, 10, 9, 0), 7).first()
    assert e.range_line == "## Week of January 03 to January 10, 2024, 09:00 (summary run at 2024-01-10 09:00)"
    assert e.stem == "20240110_0900_from_20240103"


def test_empty_input_keeps_schema(spark):
    df = recs(spark, [])
    assert stats.issues_per_source(df).count() == 0
    assert "rank" in stats.issues_per_source(df).columns


def test_broadcast_and_shuffle_paths_agree(spark):
    from briefkit.sources import tables as T
    from .conftest import SF
    r = T.records(spark, SF)
    cols = ["sender", "issues", "first_ord", "rank", "first"]
    a = sorted(stats.issues_per_source(r).select(*cols).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        b = sorted(stats.issues_per_source(r).select(*cols).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert a == b


def test_records_that_share_or_lack_their_place(spark):
    rows = [(5, "s1", "d1", "A", "x"), (5, "s2", "d2", "A", "y"), (5, "s1", "d1", "A", "z"), (None, "s", "d", "B", "b"),
            (None, "t", "e", "B", "c"), (7, "s", "d", "C", "c"), (None, "s", "d", "C", "c")]
    df = spark.createDataFrame(rows, "ord long, subject string, date string, sender string, body string")
    out = {r.sender: r for r in stats.issues_per_source(df).collect()}
    assert {k: (r.issues, r.first_ord, r["rank"]) for k, r in out.items()} == {"A": (3, 5, 1), "C": (2, 7, 2), "B": (2, None, 3)}
    assert out["C"].first.body == "c" and stats.issues_per_source(df).count() == 3
    assert tuple(stats.source_totals(df).first()) == (7, 3)
    again = {r.sender: r.first for r in stats.issues_per_source(df.repartition(5)).collect()}
    assert again == {k: r.first for k, r in out.items()}
