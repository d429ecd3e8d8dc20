"""Message resources → records (A1, C1–C5) and selection."""

import base64
import datetime as dt
import json
import os

from pyspark.sql import functions as F

from briefkit import config as cfg
from briefkit.operators.select import select_messages
from briefkit.operators.parse import b64url_text
from briefkit.sources.messages import b64url, read_messages, records_from_json_text


def b64(s: str | bytes) -> str:
    b = s.encode() if isinstance(s, str) else s
    return base64.urlsafe_b64encode(b).decode()


def msg(i, headers, parts=None, body=None, labels=("ai",)):
    payload = {"headers": [{"name": k, "value": v} for k, v in headers]}
    if parts is not None:
        payload["parts"] = parts
    if body is not None:
        payload["body"] = body
    return {"id": f"m{i}", "labelIds": list(labels), "internalDate": 1704067200000 + i, "payload": payload}


def part(mime, data):
    return {"mimeType": mime, "body": {"data": data} if data is not None else {}}


def write_lines(tmp_dir, objs):
    p = os.path.join(tmp_dir, "msgs.json")
    with open(p, "w") as f:
        f.write("\n".join(json.dumps(o) for o in objs))
    return p


H = [("Subject", "S"), ("Date", "Mon, 01 Jan 2024 12:00:00 +0000"), ("From", "A <a@x.com>"), ("To", "me@y.com")]


def test_body_choice(spark, tmp_dir):
    objs = [
        msg(0, H, body={"data": "VGVzdCBib2R5"}),                                         # direct body
        msg(1, H, parts=[part("text/plain", b64("plain")), part("text/html", b64("<p>h</p>"))]),
        msg(2, H, parts=[part("text/html", b64("first")), part("text/html", b64("second"))]),
        msg(3, H, parts=[part("text/plain", b64("only plain"))]),
        msg(4, H),                                                                        # neither
        msg(5, H, parts=[part("text/html", b64("ü ~ ?>".encode()))]),                    # '-'/'_' in base64url
        msg(6, H, parts=[part("text/html", b64(b"\xff\xfe bad"))]),                       # invalid UTF-8
        msg(7, H, parts=[part("text/html", None)]),                                       # part without data
        msg(8, H, parts=[part("image/png", b64("x"))]),                                   # no text part
    ]
    rows = {r.msg_id: r for r in read_messages(spark, write_lines(tmp_dir, objs)).collect()}
    assert (rows["m0"].body, rows["m0"].body_format) == ("Test body", "plain")
    assert (rows["m1"].body, rows["m1"].body_format) == ("<p>h</p>", "html")
    assert rows["m2"].body == "second"
    assert (rows["m3"].body, rows["m3"].body_format) == ("only plain", "plain")
    assert (rows["m4"].body, rows["m4"].body_format) == ("", None)
    assert rows["m5"].body == "ü ~ ?>" and rows["m5"].decode_ok
    assert rows["m6"].body is None and rows["m6"].decode_ok is False
    assert rows["m7"].body is None and rows["m7"].decode_ok is False
    assert (rows["m8"].body, rows["m8"].body_format) == ("", None)


def test_header_defaults(spark, tmp_dir):
    objs = [msg(0, [("Date", "x")], body={"data": b64("b")}), msg(1, [("subject", "lower")], body={"data": b64("b")})]
    rows = {r.msg_id: r for r in read_messages(spark, write_lines(tmp_dir, objs)).collect()}
    assert (rows["m0"].subject, rows["m0"].sender, rows["m0"].date) == (cfg.NO_SUBJECT, cfg.UNKNOWN_SENDER, "x")
    assert rows["m1"].subject == cfg.NO_SUBJECT  # header names are case-sensitive
    assert rows["m1"].date == cfg.NO_DATE


def _sel_df(spark):
    rows = [
        ("m1", ["ai"], "A <a@x.com>", "me@y.com", dt.datetime(2024, 1, 30, 10)),
        ("m2", ["ai"], "B <b@x.com>", "you@y.com", dt.datetime(2024, 1, 20, 10)),
        ("m3", ["other"], "A <a@x.com>", "you@y.com", dt.datetime(2024, 1, 29, 0)),
        ("m4", [], "a@x.com", "me@y.com", dt.datetime(2024, 1, 24, 0, 0, 1)),
    ]
    return spark.createDataFrame(rows, "msg_id string, labels array<string>, sender string, recipient string, "
                                       "received_ts timestamp")


def ids(df):
    return sorted(r.msg_id for r in df.collect())


def test_filters(spark):
    df = _sel_df(spark)
    as_of = dt.datetime(2024, 1, 31, 9, 30)
    assert ids(select_messages(df, as_of=as_of, days=7)) == ["m1", "m3", "m4"]
    assert ids(select_messages(df, label="ai")) == ["m1", "m2"]
    assert ids(select_messages(df, label=None)) == ["m1", "m2", "m3", "m4"]
    assert ids(select_messages(df, from_email="a@x.com")) == ["m1", "m3", "m4"]
    assert ids(select_messages(df, to_email="you@y.com")) == ["m2", "m3"]
    assert ids(select_messages(df, from_email="a@x.com", to_email="you@y.com")) == ["m3"]


def test_filter_reaches_scan(spark, tmp_dir):
    p = os.path.join(tmp_dir, "sel.parquet")
    _sel_df(spark).write.parquet(p)
    plan = select_messages(spark.read.parquet(p), as_of=dt.datetime(2024, 1, 31), days=7)._jdf \
        .queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(received_ts), GreaterThanOrEqual(received_ts" in plan


def test_inline_records(spark):
    text = json.dumps([{"subject": "a", "date": "d", "sender": "s", "body": "b"},
                       {"subject": "c", "date": "d", "sender": "s", "body": None, "body_format": "html"}])
    rows = records_from_json_text(spark, text).orderBy("ord").collect()
    assert [(r.ord, r.subject, r.body_format) for r in rows] == [(0, "a", None), (1, "c", "html")]


def test_base64url_takes_bytes_not_characters(spark):
    """Both signs of base64url are replaced as bytes; translate looks up every
    character of a body."""
    df = spark.createDataFrame([("?>?>~~é" * 9,), ("",), (None,)], "t string")
    back = df.select("t", b64url(F.col("t")).alias("u")).select("t", "u", b64url_text(F.col("u")).alias("b"))
    assert "translate" not in back._jdf.queryExecution().analyzed().toString()
    rows = back.collect()
    assert all(r.t == r.b for r in rows) and "-" in rows[0].u + rows[1].u and not set("+/\r\n") & set(rows[0].u)
