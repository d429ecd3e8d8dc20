"""URL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as cfg

URL_RX = cfg.RX_URL[1]
_BLOCK_RX = "|".join(re.escape(b) for b in cfg.BODY_URL_BLOCKLIST)
_TRACK_RX = "|".join(re.escape(b) for b in cfg.REGISTRY_TRACKING_PATTERNS)


def extract_urls(body: Column) -> Column:
    """C14: every URL in the raw body, in order."""
    return F.coalesce(F.regexp_extract_all(body, F.lit(URL_RX), 0), F.array().cast("array<string>"))


def drop_tracking(urls: Column) -> Column:
    """Drop URLs containing any blocked substring (case-sensitive)."""
    return F.filter(urls, lambda u: ~u.rlike(_BLOCK_RX))


def url_path(u: Column) -> Column:
    """Path component as urlparse gives it ('' when absent)."""
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_host(u: Column) -> Column:
    """Network location (lower-cased) as urlparse gives it."""
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def homepage_from_body(body: Column) -> Column:
    """First kept URL whose path is a root, else the first kept URL."""
    kept = drop_tracking(extract_urls(body))
    roots = F.filter(kept, lambda u: url_path(u).isin(*cfg.ROOT_PATHS))
    return F.coalesce(F.get(roots, 0), F.get(kept, 0))


def is_valid_url(u: Column) -> Column:
    """http/https scheme (any case) and a non-empty authority."""
    return F.coalesce(u.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def is_tracking_url(u: Column) -> Column:
    """I8: tracking/temporary pattern in the lower-cased URL."""
    return F.coalesce(F.lower(u).rlike(_TRACK_RX), F.lit(False))


def is_generic_url(u: Column) -> Column:
    """A bare generic host ('' or '/' path)."""
    return F.coalesce(url_host(u).isin(*cfg.GENERIC_HOSTS) & url_path(u).isin("", "/"), F.lit(False))
