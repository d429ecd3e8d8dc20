"""Message resource → flat record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from .. import schemas
from ..functions.common import let


def header(headers: Column, name: str, default: str) -> Column:
    """First header with this exact (case-sensitive) name."""
    return F.coalesce(F.get(F.filter(headers, lambda h: h["name"] == name), 0)["value"], F.lit(default))


def b64url_text(data: Column) -> Column:
    """base64url → bytes → UTF-8 text; NULL when either step fails."""
    # two replacements of bytes: translate looks every character up
    b = F.try_to_binary(F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")), F.lit("base64"))
    return let(b.cast("string"), lambda s: F.when(F.is_valid_utf8(s), s))


def _last_part(parts: Column, mime: str) -> Column:
    return F.try_element_at(F.filter(parts, lambda p: p["mimeType"] == mime), F.lit(-1))


def parse_messages(msgs: DataFrame, raw: bool = False) -> DataFrame:
    """C1–C5.  Output: id, labels, subject, date, sender, recipient, body,
    body_format, decode_ok (false when a line or a chosen part could not be decoded:
    the original aborts the whole run there; the build flags the row).  With
    ``raw``, also what such a row came from: the line, or the message as JSON."""
    p = F.col("payload")
    parts = p["parts"]
    has_parts = parts.isNotNull()
    html_p, text_p = _last_part(parts, "text/html"), _last_part(parts, "text/plain")
    direct = p["body"]["data"]
    kind = (F.when(has_parts & html_p.isNotNull(), F.lit("html"))
            .when(has_parts & text_p.isNotNull(), F.lit("plain"))
            .when(~has_parts & direct.isNotNull(), F.lit("direct")))
    data = (F.when(kind == "html", html_p["body"]["data"])
            .when(kind == "plain", text_p["body"]["data"])
            .when(kind == "direct", direct))
    fmt = F.when(kind == "html", F.lit("html")).when(kind.isNotNull(), F.lit("plain"))
    text = b64url_text(data)
    hs = p["headers"]
    line = F.col("_corrupt_record") if "_corrupt_record" in msgs.columns else F.lit(None).cast("string")
    whole = line.isNull()
    more = [line.alias("raw_line"), F.when(whole & kind.isNotNull() & text.isNull(), F.to_json(F.struct(*schemas.MESSAGE.names))).alias("raw_message")] if raw else []
    return msgs.select(
        F.col("id").alias("msg_id"),
        F.coalesce(F.col("labelIds"), F.array().cast("array<string>")).alias("labels"),
        header(hs, "Subject", cfg.NO_SUBJECT).alias("subject"),
        header(hs, "Date", cfg.NO_DATE).alias("date"),
        header(hs, "From", cfg.UNKNOWN_SENDER).alias("sender"),
        F.get(F.filter(hs, lambda h: h["name"] == "To"), 0)["value"].alias("recipient"),
        F.when(kind.isNull(), F.lit("")).otherwise(text).alias("body"),
        fmt.alias("body_format"),
        (whole & (kind.isNull() | text.isNotNull())).alias("decode_ok"),
        F.col("internalDate"),
        *more,
    )
