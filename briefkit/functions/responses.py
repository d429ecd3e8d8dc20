"""Model response functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as cfg
from ..schemas import RESPONSE
from .common import let

TITLE_RX = cfg.RX_TOPIC_TITLE[1]


def parse_response(resp: Column) -> Column:
    """JSON response envelope → STRUCT (NULL for malformed JSON)."""
    return F.from_json(resp, RESPONSE, {"mode": "PERMISSIVE"})


def response_text(parsed: Column) -> Column:
    return F.get(parsed["choices"], 0)["message"]["content"]


def topic_titles(text: Column) -> Column:
    """C19: '### N. title' headings that end with a newline, in order."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TITLE_RX), 1), F.array().cast("array<string>"))


def topics(text: Column) -> Column:
    """The titles of C19 with what follows each up to the next heading:
    ARRAY<STRUCT<title, body>>, empty for NULL."""
    head = TITLE_RX.rsplit("(.*?)", 1)[0].removeprefix("(?d)")
    rx = F.lit(rf"{TITLE_RX}((?s:.*?))(?={head}|\z)")
    return F.coalesce(F.arrays_zip(F.regexp_extract_all(text, rx, 1).alias("title"), F.regexp_extract_all(text, rx, 2).alias("body")),
                      F.array().cast("array<struct<title:string,body:string>>"))


def keep_topics(text: Column, n: int) -> Column:
    """A reply cut to its first ``n`` topics with different titles, numbered
    from 1; a reply without any heading stays as it is."""
    def first(found: Column) -> Column:
        titles = F.transform(found, lambda t: t["title"])
        return F.slice(F.filter(found, lambda t, i: F.array_position(titles, t["title"]) == i + 1), 1, n)

    lines = F.transform(let(topics(text), first), lambda t, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), t["title"], F.lit("\n"), t["body"]))
    return F.coalesce(F.nullif(F.array_join(lines, ""), F.lit("")), text)
