"""Spark functions and their DuckDB SQL twins agree on random inputs."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from briefkit.functions.html import clean_body
from briefkit.functions.text import clean_subject, normalize, sender_email, sender_name
from briefkit.functions.urls import homepage_from_body
from briefkit.plans import oracle as O

FRAGMENTS = ["<p>", "</p>", "<div class='x'>", "</div>", "<br/>", "<h2>", "</h2>", "<li>", "</li>", "<ul>",
             "<script>var a=1;</script>", "<style>p{x:1}</style>", "<!-- c -->", "<a href='https://e.com/'>",
             "</a>", "<b>", "&amp;", "&lt;", "&nbsp;", " ", "  ", "\n", "\t", "text", "Ünï", "é", ".cls {a:b}",
             "@media x {y}", "{z}", "<di", "https://ok.com/home", "https://track.x.com/p", "[T] ", "Pre: ",
             "Name <a@b.c>", ":", "<META charset=1>", "<LINK rel=x>", "<H1>", "</H1>"]

texts = st.lists(st.sampled_from(FRAGMENTS), min_size=0, max_size=25).map("".join)


def both(spark, values, spark_fn, sql_fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    s = [r[0] for r in df.orderBy("i").select(spark_fn(F.col("x"))).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    d = [r[0] for r in con.execute(f"SELECT {sql_fn('x')} FROM t ORDER BY i").fetchall()]
    return s, d


@settings(max_examples=15, deadline=None)
@given(st.lists(texts, min_size=5, max_size=5))
def test_clean_body_parity(spark, values):
    s, d = both(spark, values, clean_body, O.clean_body)
    assert s == d


@settings(max_examples=10, deadline=None)
@given(st.lists(texts, min_size=5, max_size=5))
def test_text_function_parity(spark, values):
    for sf, qf in ((clean_subject, O.clean_subject), (normalize, O.normalize), (sender_name, O.sender_name),
                   (sender_email, O.sender_email), (homepage_from_body, O.homepage_from_body)):
        s, d = both(spark, values, sf, qf)
        assert s == d, sf.__name__
