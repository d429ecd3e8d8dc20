"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver's tables registered as views.
Patterns are written here in RE2's own terms (no look-around, no
back-references, ``'g'`` for global replace) from the rules of the survey, and
not taken from the Spark side; only word lists, fixed texts and run parameters
are shared (``config``, ``catalog``).
"""

from __future__ import annotations

from .. import config as cfg

# White space as Python's str.isspace() has it: ASCII blanks, the separators
# 1C to 1F, NEL, and all Unicode separators.
_W = r"\s\v\x1c-\x1f\x{85}\p{Z}"
WS, INK = f"[{_W}]", f"[^{_W}]"
WORD = r"\p{L}\p{N}_"

SENDER_RX = f"^(.*?){WS}*<(.+?)>"
TITLE_RX = rf"###{WS}*\p{{Nd}}+\.{WS}*([^\n]*)\n"
URL_RX = rf"https?://[{WORD}.\-]+(?:/[{WORD}./?%&=\-]*)?"
DATE_RX = (rf"^{WS}*(?:[^,{_W}]*,{WS}*|(?i:sun|mon|tue|wed|thu|fri|sat){WS}+)?"
           rf"(?:(\d\d?),?{WS}+([A-Za-z]+)|([A-Za-z]+){WS}+(\d\d?),?)"
           rf"{WS}+(\d{{1,4}}),?{WS}+(\d\d?):(\d\d?)(?::(\d\d?))?"
           rf"(?:{WS}*([+-]\d+)|{WS}+({INK}+))?(?:{WS}.*)?$")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(cfg.PY_WHITESPACE_CHARS)})"


PAGE_SITE = r"""
page_site AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
         regexp_extract(url, '([a-z-]+)[.]example[.]', 1) AS site,
         regexp_extract(html, '<title>([^<]*)', 1) AS title
  FROM pages)"""

MSGS = PAGE_SITE + r""",
msgs AS (
  SELECT e.event_id AS ord, 'm' || CAST(e.event_id AS VARCHAR) AS msg_id, e.event_type AS label, e.ts AS event_ts,
    CASE WHEN e.event_type = 'signup' THEN '[' || p.site || '] New release: ' || p.title
         WHEN e.event_type = 'purchase' THEN p.site || ' Weekly: ' || p.title
         ELSE p.title END AS subject,
    CASE WHEN e.event_type = 'view' THEN strftime(e.ts, '%a, %d %b %Y %H:%M:%S') || ' +0000'
         WHEN e.event_type = 'click' THEN strftime(e.ts - INTERVAL 5 HOUR, '%a, %-d %b %Y %H:%M:%S') || ' EST'
         WHEN e.event_type = 'signup' THEN strftime(e.ts, '%d %b %Y %H:%M:%S') || ' -0000'
         WHEN e.event_type = 'purchase' THEN strftime(e.ts + INTERVAL 330 MINUTE, '%a, %d %b %y %H:%M') || ' +0530 (IST)'
         ELSE strftime(e.ts, '%Y-%m-%dT%H:%M:%S') END AS date,
    CASE WHEN starts_with(p.host, 'blog.') THEN 'news@' || p.host
         WHEN starts_with(p.url, 'http:') THEN p.site || ' Daily <news@mail.' || p.host || '>'
         ELSE p.site || ' <news@mail.' || p.host || '>' END AS sender,
    'reader' || regexp_extract(e.props, '[0-9]+', 0) || '@inbox.example.org' AS recipient,
    p.html || '<p>Read online: https://t.track.example.com/c?e=' || CAST(e.event_id AS VARCHAR) || ' ' || p.url
      || CASE WHEN e.event_type IN ('view', 'click') THEN ' https://' || p.host || '/' ELSE '' END || '</p>' AS body,
    'html' AS body_format
  FROM events e JOIN page_site p ON e.user_id = p.page_id)"""


def _zone_case(col: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in cfg.ZONE_OFFSETS_HHMM.items())
    return f"CASE upper({col}) {whens} END"


_MONTHS = "[" + ", ".join(q(m) for m in cfg.MONTH_ABBR + cfg.MONTH_FULL) + "]"

# C11 over a relation ``src`` with a ``date`` column → adds p_ts, p_local,
# p_off, p_tz_known, p_ok.
PARSE_DATES = r"""
rx AS (SELECT *, regexp_extract(date, {rx}, ['d1','m1','m2','d2','yy','hh','mi','ss','nz','az']) AS g,
              coalesce(regexp_matches(date, {rx}), false) AS g_ok FROM {src}),
px AS (
  SELECT *,
    CAST(coalesce(nullif(g.d1, ''), nullif(g.d2, '')) AS INTEGER) AS x_day,
    list_position({months}, lower(coalesce(nullif(g.m1, ''), nullif(g.m2, '')))) AS x_mpos,
    CAST(nullif(g.yy, '') AS INTEGER) AS x_yy,
    CAST(nullif(g.hh, '') AS INTEGER) AS x_hh,
    CAST(nullif(g.mi, '') AS INTEGER) AS x_mi,
    coalesce(CAST(nullif(g.ss, '') AS INTEGER), 0) AS x_ss,
    coalesce(CASE WHEN regexp_matches(nullif(g.nz, ''), '^[+-]\d{{1,9}}$') THEN TRY_CAST(g.nz AS INTEGER) END,
             {zone},
             CASE WHEN regexp_matches(nullif(g.az, ''), '^[+-]?\d{{1,9}}$') THEN TRY_CAST(g.az AS INTEGER) END) AS x_hhmm0,
    coalesce(nullif(g.nz, ''), nullif(g.az, '')) AS x_ztok
  FROM rx),
py AS (
  SELECT *,
    CASE WHEN x_mpos > 0 THEN ((x_mpos - 1) % 12) + 1 END AS x_month,
    CASE WHEN x_yy < 100 THEN (CASE WHEN x_yy > 68 THEN x_yy + 1900 ELSE x_yy + 2000 END) ELSE x_yy END AS x_year,
    CASE WHEN x_hhmm0 = 0 AND starts_with(x_ztok, '-') THEN NULL ELSE x_hhmm0 END AS x_hhmm
  FROM px),
pz AS (
  SELECT *,
    CAST(sign(x_hhmm) * ((abs(x_hhmm) // 100) * 3600 + (abs(x_hhmm) % 100) * 60) AS INTEGER) AS p_off,
    CASE WHEN g_ok AND x_month IS NOT NULL AND x_hh BETWEEN 0 AND 23 AND x_mi BETWEEN 0 AND 59
              AND x_ss BETWEEN 0 AND 59 AND x_year >= 1
         THEN try(make_timestamp(x_year, x_month, x_day, x_hh, x_mi, x_ss)) END AS p_local
  FROM py),
{out} AS (
  SELECT *, p_local - to_seconds(coalesce(p_off, 0)) AS p_ts,
         CASE WHEN p_local IS NOT NULL THEN p_off IS NOT NULL END AS p_tz_known,
         p_local IS NOT NULL AS p_ok
  FROM pz)"""


def parse_dates(src: str, out: str) -> str:
    return PARSE_DATES.format(rx=q(DATE_RX), months=_MONTHS, zone=_zone_case("nullif(g.az, '')"), src=src, out=out)


def sender_name(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {q(SENDER_RX)}) THEN regexp_extract({x}, {q(SENDER_RX)}, 1) ELSE {x} END"


def sender_email(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {q(SENDER_RX)}) THEN regexp_extract({x}, {q(SENDER_RX)}, 2) END"


def short_sender(x: str) -> str:
    return strip(f"split_part({x}, '<', 1)")


def normalize(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^0-9a-z]+', '', 'g')"


def email_domain(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '([^@]*)$', 1), '^(newsletter|mail|news|info)[.]', '')"


def clean_subject(x: str) -> str:
    s1 = strip(f"regexp_replace({x}, '^\\[[^\\]\\n]*\\]', '')")
    return strip(f"regexp_replace({s1}, '^[^:\\n]*:', '')")


def breaking(x: str) -> str:
    import re as _re
    rx = "|".join(_re.escape(p) for p in cfg.BREAKING_PHRASES)
    return f"coalesce(regexp_matches(lower({x}), {q(rx)}), false)"


def homepage_from_body(x: str) -> str:
    import re as _re
    block = "|".join(_re.escape(b) for b in cfg.BODY_URL_BLOCKLIST)
    kept = (f"list_filter(coalesce(regexp_extract_all({x}, {q(URL_RX)}, 0), []), "
            f"lambda u: NOT regexp_matches(u, {q(block)}))")
    path = "regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    roots = ", ".join(q(r) for r in cfg.ROOT_PATHS)
    return f"coalesce(list_filter({kept}, lambda u: {path} IN ({roots}))[1], ({kept})[1])"


def _gsub(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"
    return x


#: Elements that go with their content (to the end if not closed), then
#: the attributes of every tag that has more than its name.
ELEMENTS = [(r"(?is)<!--.*?-->|<script\b[^>]*>.*?(</script\s*>|\z)|<style\b[^>]*>.*?(</style\s*>|\z)|<(meta|link)\b[^>]*>|<![^>]*>", ""),
            (r"<([A-Za-z][A-Za-z0-9:\-]*)[^A-Za-z0-9:>\-][^>]*>", r"<\1>")]
#: D3: media blocks, then rules of classes, then any braces.
CSS = [(r"@media[^{]+\{[^}]+\}", ""), (rf"\.[{WORD}\-]+[^{{]*\{{[^}}]+\}}", ""), (r"\{[^}]+\}", "")]
#: Headings, blocks, items, other and cut-off tags.
TAGS = [(f"<[hH]{n}>", "\n" + "#" * n + " ") for n in range(1, 7)] + [
    (r"(?i)</?(html|head|body|title|p|div|br|hr|pre|blockquote|table|thead|tbody|tr|ul|ol|article|section|header|footer|nav|main|aside)>|</h[1-6]>", "\n"),
    (r"(?i)<li>", "\n* "), (r"</?[A-Za-z][A-Za-z0-9:\-]*>|<[A-Za-z/][^>]*\z", "")]
REFERENCES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "copy": "©", "middot": "·",
              "mdash": "—", "ndash": "–", "hellip": "…", "amp": "&"}
SPACES = [(r"[ \t]{2,}|\t", " "), (r" \n ?|\n ", "\n"), (r"\n{3,}", "\n\n")]


def strip_css(x: str) -> str:
    return _gsub(x, ELEMENTS + CSS)


def clean_body(x: str) -> str:
    c = _gsub(strip_css(x), TAGS)
    for name, char in REFERENCES.items():   # & last, so that nothing is decoded twice
        c = f"replace({c}, {q('&' + name + ';')}, {q(char)})"
    return f"coalesce({strip(_gsub(c, SPACES))}, {q(cfg.CLEAN_ERROR)})"
