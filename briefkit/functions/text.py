"""String functions on Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as cfg
from .common import let


# Sender "Name <address>" (Python re.match anchors at the start only).
SENDER_RX = cfg.RX_SENDER[1]


def py_strip(c: Column) -> Column:
    """Python's strip(): trims the whole str.isspace() set (no regex)."""
    return F.btrim(c, F.lit(cfg.PY_WHITESPACE_CHARS))


def short_sender(sender: Column) -> Column:
    """Text before the first '<', stripped."""
    return py_strip(F.substring_index(sender, "<", 1))


def sender_matches(sender: Column) -> Column:
    return sender.rlike(SENDER_RX)


def sender_name(sender: Column) -> Column:
    """Display name; the whole sender when it has no <address>."""
    return F.when(sender_matches(sender), F.regexp_extract(sender, SENDER_RX, 1)).otherwise(sender)


def sender_email(sender: Column) -> Column:
    """Address inside <...>; NULL when absent."""
    return F.when(sender_matches(sender), F.regexp_extract(sender, SENDER_RX, 2))


def registry_key(name: Column) -> Column:
    """Name.strip().lower()."""
    return F.lower(py_strip(name))


def normalize(c: Column) -> Column:
    """Lower-case and keep [a-z0-9] only."""
    return F.regexp_replace(F.lower(c), cfg.RX_NORMALIZE[1], "")


def email_domain(email: Column) -> Column:
    """Part after the last '@', one mail-host prefix removed."""
    return F.regexp_replace(F.substring_index(email, "@", -1), cfg.RX_MAIL_PREFIX[1], "")


def clean_subject(subject: Column) -> Column:
    """Drop a leading [tag], strip, drop through the first colon, strip."""
    s = py_strip(F.regexp_replace(subject, cfg.RX_SUBJECT_TAG[1], ""))
    return py_strip(F.regexp_replace(s, cfg.RX_SUBJECT_PREFIX[1], ""))


def is_breaking(subject: Column) -> Column:
    """Any announcement phrase in the lower-cased raw subject."""
    rx = "|".join(re.escape(p) for p in cfg.BREAKING_PHRASES)
    return F.coalesce(F.lower(subject).rlike(rx), F.lit(False))


def truncate_item(c: Column, limit: int = cfg.ITEM_CHAR_LIMIT) -> Column:
    """C17: first ``limit`` characters, always followed by '...'."""
    return F.concat(F.substring(c, 1, limit), F.lit(cfg.ITEM_SUFFIX))


#: What repr() escapes beyond Latin-1: characters that are not printable.
_UNPRINTABLE_RX = r"[[\p{C}\p{Z}]&&[^\x00-\xFF]]"


def py_repr(c: Column) -> Column:
    """repr() of a Python str: quotes, backslash, \\n \\t \\r, and what is not
    printable as \\xNN, \\uNNNN or \\UNNNNNNNN (by the JVM's Unicode tables)."""
    esc = F.regexp_replace(c, r"\\", r"\\\\")
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace(esc, "\n", r"\\n"), "\t", r"\\t"), "\r", r"\\r")
    for n in [*range(0x01, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA1), 0xAD]:
        esc = F.replace(esc, F.lit(chr(n)), F.lit(f"\\x{n:02x}"))

    def char(x: Column) -> Column:
        code = F.lower(F.hex(F.encode(x, "UTF-32")))
        return F.when(~x.rlike(_UNPRINTABLE_RX), x).when(code.startswith("0000"), F.concat(F.lit("\\u"), F.substring(code, 5, 4))) \
            .otherwise(F.concat(F.lit("\\U"), code))

    esc = let(esc, lambda v: F.when(v.rlike(_UNPRINTABLE_RX), F.array_join(F.transform(F.regexp_extract_all(v, F.lit("(?s)."), 0), char), "")).otherwise(v))
    dq = esc.contains("'") & ~esc.contains('"')
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'")))


def json_repr(json: Column) -> Column:
    """repr() of the Python value that compact JSON text stands for: strings as
    above, True, False, None, and a blank after each comma and colon."""
    def token(t: Column) -> Column:
        said = py_repr(F.variant_get(F.try_parse_json(t), "$", "string"))
        plain = F.replace(F.replace(t, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
        for name, value in (("true", "True"), ("false", "False"), ("null", "None")):
            plain = F.replace(plain, F.lit(name), F.lit(value))
        return F.when(t.startswith('"'), said).otherwise(plain)
    tokens = F.regexp_extract_all(json, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]+'), 0)
    return F.array_join(F.transform(tokens, token), "")
