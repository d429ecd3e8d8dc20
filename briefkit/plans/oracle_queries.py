"""DuckDB SQL for every registered query (see ``plans.catalog``)."""

from __future__ import annotations

import datetime as dt
import re

from .. import config as cfg
from ..operators.prompts import PROMPT_HEAD
from . import catalog as C
from . import oracle as O

TS_SQL = "%Y-%m-%d %H:%M:%S"
B = cfg.PROMPT_BATCH_ITEMS
NL = "chr(10)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _rx(items) -> str:
    return "|".join(re.escape(x) for x in items)


# ----------------------------------------------------------------- adapters
COST_LOG = """
c AS (
  SELECT event_id AS ord, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
         'm' || regexp_extract(props, '[0-9]', 0) AS model,
         CASE WHEN event_type <> 'error' THEN event_type END AS provider,
         user_id AS prompt_tokens, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS completion_tokens,
         user_id + CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS total_tokens, value AS cost
  FROM events)"""

REGISTRY = """
reg AS (SELECT site AS name, min(url) AS url, starts_with(min(url), 'https://') AS verified
        FROM page_site GROUP BY site)"""

CURATED = """
cur AS (SELECT site AS name, min(page_id) AS ord, 'https://www.' || site || '.example.com' AS url
        FROM page_site WHERE starts_with(host, 'www.') GROUP BY site)"""

SITE_ROWS = """
sr AS (
  SELECT page_id AS ord,
         site || '-' || CAST(page_id AS VARCHAR) || CASE WHEN ends_with(url, '#top') THEN ' ' ELSE '' END AS name,
         CASE WHEN starts_with(url, 'http://www.') THEN regexp_replace(url, '^http://', 'ftp://')
              WHEN contains(url, 'page=2') THEN 'https://substack.com'
              WHEN ends_with(url, '.html') THEN 'https://' || host || '/'
              ELSE url END AS url,
         starts_with(url, 'https://') AS verified
  FROM page_site)"""

DECISIONS = r"""
dec AS (
  SELECT name,
         CASE WHEN contains(url, 'utm_') THEN 'e' WHEN contains(url, 'blog.') THEN ' D '
              WHEN contains(url, '#top') THEN 'A' WHEN contains(url, 'page=2') THEN 'x' ELSE 's' END AS action,
         CASE WHEN contains(url, 'utm_') THEN regexp_replace(url, '\?.*$', '') END AS new_url
  FROM reg WHERE NOT coalesce(verified, false))"""

SEQ = "s AS (SELECT *, row_number() OVER (ORDER BY ord) AS seq FROM msgs)"


def rollup_ctes(days: int = C.COST_DAYS) -> list[str]:
    cutoff = (C.RUN_TS - dt.timedelta(days=days)).isoformat()
    return [COST_LOG, f"""f AS (
          SELECT coalesce(provider, 'unknown') AS provider, coalesce(model, 'unknown') AS model,
                 coalesce(total_tokens, 0) AS tokens, coalesce(cost, 0) AS cost, ord
          FROM c WHERE coalesce(timestamp, '') >= '{cutoff}')""", """g0 AS (
          SELECT grouping(provider, model) AS gid, provider, model, count(*) AS runs,
                 CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost, min(ord) AS first_ord
          FROM f GROUP BY GROUPING SETS ((), (provider), (model)))""", """g AS (
          SELECT CASE gid WHEN 3 THEN 'total' WHEN 1 THEN 'provider' ELSE 'model' END AS level,
                 CASE gid WHEN 1 THEN provider WHEN 2 THEN model END AS key, runs, tokens, cost, first_ord FROM g0)"""]


RESOURCE_BODY = (f"CASE WHEN label IN ('view', 'click') THEN body WHEN label = 'signup' THEN subject || {NL} || recipient "
                 "WHEN label = 'purchase' THEN subject ELSE '' END")


def resolved_ctes(body: str = "body") -> list[str]:
    name, email = O.sender_name("sender"), O.sender_email("sender")
    return [O.MSGS, REGISTRY, CURATED, f"""g AS (
          SELECT sender, count(*) AS issues, min(ord) AS first_ord, arg_min({body}, ord) AS body FROM msgs
          GROUP BY sender)""",
            f"""srcs AS (
          SELECT sender, issues, row_number() OVER (ORDER BY issues DESC, first_ord) AS rank, body,
                 {name} AS name, {email} AS email FROM g)""",
            f"""s2 AS (
          SELECT *, lower({O.strip('name')}) AS key, {O.normalize('name')} AS norm, {O.email_domain('email')} AS domain
          FROM srcs)""",
            f"""cm AS (
          SELECT s2.sender, arg_min(cur.url, cur.ord) AS curated_url
          FROM s2 JOIN cur ON contains(s2.norm, {O.normalize('cur.name')}) GROUP BY s2.sender)""",
            "r AS (SELECT name AS key, url AS reg_url FROM reg WHERE coalesce(verified, false) AND length(url) > 0)",
            "j AS (SELECT s2.*, cm.curated_url, r.reg_url FROM s2 LEFT JOIN cm USING (sender) LEFT JOIN r USING (key))",
            f"""k AS (
          SELECT *, CASE WHEN length(norm) > 3 AND contains(domain, norm) AND length(email) > 0
                         THEN 'https://' || domain END AS domain_url,
                 {O.homepage_from_body('body')} AS body_url FROM j)""",
            """res AS (
          SELECT sender, name, email, key, issues, rank, coalesce(reg_url, curated_url, domain_url, body_url) AS url,
                 CASE WHEN reg_url IS NOT NULL THEN 'registry' WHEN curated_url IS NOT NULL THEN 'curated'
                      WHEN domain_url IS NOT NULL THEN 'domain' WHEN body_url IS NOT NULL THEN 'body' END AS url_source,
                 (reg_url IS NOT NULL OR curated_url IS NOT NULL) AS verified FROM k)""",
            f"""slines AS (
          SELECT rank, CASE WHEN url IS NOT NULL AND length(url) > 0
                 THEN '- [' || {O.strip('name')} || '](' || url || ') - ' || CAST(issues AS VARCHAR) || ' issues'
                 ELSE '- ' || {O.strip('name')} || ' - ' || CAST(issues AS VARCHAR) || ' issues' END AS line FROM res)"""]


def py_repr(x: str) -> str:
    bs = "\\"
    esc = (f"replace(replace(replace(replace({x}, '{bs}', '{bs}{bs}'), chr(10), '{bs}n'), chr(9), '{bs}t'), "
           f"chr(13), '{bs}r')")
    return (f"CASE WHEN contains({esc}, '''') AND NOT contains({esc}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '{bs}''') || '''' END")


def errors_ctes() -> list[str]:
    host = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
    path = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    generic = ", ".join(O.q(h) for h in cfg.GENERIC_HOSTS)
    track = O.q(_rx(cfg.REGISTRY_TRACKING_PATTERNS))
    return [O.PAGE_SITE, SITE_ROWS, f"""e AS (
          SELECT *, coalesce(length({O.strip('name')}) = 0, true) AS blank, url IS NOT NULL AS url_is_string,
                 coalesce(regexp_matches(url, '^(?i:https?)://[^/?#]+'), false) AS valid FROM sr)""",
            "e2 AS (SELECT *, NOT blank AND url_is_string AND valid AS reach FROM e)",
            "own AS (SELECT url, arg_min(name, ord) AS own_name, min(ord) AS own_ord FROM e2 WHERE reach GROUP BY url)",
            "e3 AS (SELECT e2.*, own.own_name, own.own_ord FROM e2 LEFT JOIN own USING (url))",
            f"""errs AS (
          SELECT ord, name, 1 AS rule_seq, 'I1' AS rule_id,
                 'Newsletter name must be a non-empty string: ' || coalesce({py_repr('name')}, 'None') AS message
          FROM e3 WHERE blank
          UNION ALL SELECT ord, name, 2, 'I2', 'Newsletter name has leading/trailing whitespace: ' || {py_repr('name')}
          FROM e3 WHERE NOT blank AND name <> {O.strip('name')}
          UNION ALL SELECT ord, name, 6, 'I6', 'URL for ''' || name || ''' must be a string: None'
          FROM e3 WHERE NOT blank AND NOT url_is_string
          UNION ALL SELECT ord, name, 7, 'I7', 'Invalid URL for ''' || name || ''': ' || url
          FROM e3 WHERE NOT blank AND url_is_string AND NOT valid
          UNION ALL SELECT ord, name, 8, 'I8', 'URL for ''' || name || ''' appears to be a tracking/temporary URL: ' || url
          FROM e3 WHERE reach AND regexp_matches(lower(url), {track})
          UNION ALL SELECT ord, name, 9, 'I9', 'URL for ''' || name || ''' is too generic, should be more specific: ' || url
          FROM e3 WHERE reach AND {host} IN ({generic}) AND {path} IN ('', '/')
          UNION ALL SELECT ord, name, 10, 'I10',
                 'Duplicate URL found: ''' || name || ''' and ''' || own_name || ''' both use ' || url
          FROM e3 WHERE reach AND own_ord <> ord
          UNION ALL SELECT ord, name, 11, 'I11', '''verified'' field for ''' || name || ''' must be a boolean: None'
          FROM e3 WHERE reach AND verified IS NULL)"""]


def report_errors_sql() -> str:
    """each category's errors, numbered in file order."""
    def errs(sr: str) -> str:
        return _with(*[sr if c is SITE_ROWS else c for c in errors_ctes()]) + "SELECT ord, rule_seq, message FROM errs"

    site = "CASE k WHEN 0 THEN '  ' ELSE site || '-' || CAST(page_id AS VARCHAR) END"
    untyped = f"""WITH {O.PAGE_SITE}, u AS (SELECT *, page_id % 10 AS k FROM page_site), m AS (SELECT page_id AS ord, k, {site} AS name FROM u)
        SELECT ord, CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 7 THEN 11 WHEN 8 THEN 11 ELSE 6 END AS rule_seq,
          CASE k WHEN 0 THEN 'Newsletter name must be a non-empty string: ''  '''
            WHEN 1 THEN 'Configuration for ''' || name || ''' must be a dictionary' WHEN 2 THEN 'Configuration for ''' || name || ''' must be a dictionary'
            WHEN 3 THEN 'Missing ''url'' field for newsletter ''' || name || '''' WHEN 4 THEN 'Missing ''verified'' field for newsletter ''' || name || ''''
            WHEN 5 THEN 'URL for ''' || name || ''' must be a string: 5' WHEN 6 THEN 'URL for ''' || name || ''' must be a string: None'
            WHEN 7 THEN '''verified'' field for ''' || name || ''' must be a boolean: ''yes''' WHEN 8 THEN '''verified'' field for ''' || name || ''' must be a boolean: None'
            ELSE 'URL for ''' || name || ''' must be a string: [''a'', ''b'']' END AS message FROM m"""
    reg = "sr AS (SELECT min(page_id) AS ord, site AS name, min(url) AS url, starts_with(min(url), 'https://') AS verified FROM page_site GROUP BY site)"
    cur = "sr AS (SELECT min(page_id) AS ord, {0} AS name, {1} AS url, true AS verified FROM page_site WHERE starts_with(host, 'www.') GROUP BY site)"
    parts = [errs(SITE_ROWS), untyped, errs(reg), errs(cur.format("site", "'https://www.' || site || '.example.com'")), errs(cur.format("' ' || site", "CAST(NULL AS VARCHAR)"))]
    each = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS category_no, * FROM ({p})" for i, p in enumerate(parts))
    names = ", ".join(f"({i}, {O.q(c)})" for i, c in enumerate(C.CATEGORIES))
    return f"""WITH a AS ({each}), c AS (SELECT * FROM (VALUES {names}) AS t(category_no, category))
        SELECT c.category_no, category, count(message) OVER (PARTITION BY c.category_no) = 0 AS is_valid, (SELECT count(*) FROM a) = 0 AS all_valid,
          count(message) OVER (PARTITION BY c.category_no) AS n_errors,
          CASE WHEN message IS NOT NULL THEN row_number() OVER (PARTITION BY c.category_no ORDER BY ord, rule_seq) END AS error_no, message
        FROM c LEFT JOIN a USING (category_no)"""


def block_sql() -> str:
    item = f"CAST((seq - 1) % {B} + 1 AS BIGINT)"
    return (f"'NEWSLETTER #' || CAST({item} AS VARCHAR) || {NL} || 'SUBJECT: ' || coalesce(subject, 'None') || {NL}"
            f" || 'SENDER: ' || coalesce(sender, 'None') || {NL} || 'DATE: ' || coalesce(date, 'None') || {NL}"
            f" || 'CONTENT:' || {NL} || substr({O.clean_body('body')}, 1, {cfg.ITEM_CHAR_LIMIT}) || '...' || {NL} || {NL}")


def items_ctes() -> list[str]:
    return [O.MSGS, SEQ, f"""items AS (
          SELECT ord, CAST((seq - 1) // {B} AS BIGINT) AS batch_id, CAST((seq - 1) % {B} + 1 AS BIGINT) AS item_no,
                 {block_sql()} AS block FROM s)"""]


def budget_ctes(budget: int) -> list[str]:
    head = (f"'NEWSLETTER #' || {NL} || 'SUBJECT: ' || coalesce(subject, 'None') || {NL}"
            f" || 'SENDER: ' || coalesce(sender, 'None') || {NL} || 'DATE: ' || coalesce(date, 'None') || {NL}"
            f" || 'CONTENT:' || {NL} || content || {NL} || {NL}")
    return [O.MSGS, f"""b0 AS (
          SELECT ord, subject, sender, date,
                 substr({O.clean_body('body')}, 1, {cfg.ITEM_CHAR_LIMIT}) || '...' AS content FROM msgs)""",
            f"b1 AS (SELECT *, CAST(length({head}) AS BIGINT) AS len FROM b0)",
            "b2 AS (SELECT *, sum(len) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM b1)",
            f"b3 AS (SELECT *, CAST(floor((cum - len) / {budget}) AS BIGINT) AS batch_id FROM b2)",
            "b4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY ord) AS BIGINT) AS item_no FROM b3)"]


def analysis_ctes() -> list[str]:
    """The stub scorer's reply per batch: '### i. subject' + source line."""
    return [O.MSGS, SEQ, f"""an AS (
          SELECT CAST((seq - 1) // {B} AS BIGINT) AS batch_id,
                 string_agg('### ' || CAST((seq - 1) % {B} + 1 AS VARCHAR) || '. ' || coalesce(subject, 'None')
                            || {NL} || '- **Source:** stub' || {NL} || {NL}, '' ORDER BY seq) AS text
          FROM s GROUP BY 1)"""]


def extent_ctes(days: int = C.DAYS) -> list[str]:
    run_s = C.RUN_TS.strftime("%Y-%m-%d %H:%M")
    fb = f"TIMESTAMP '{C.RUN_TS}' - INTERVAL {days} DAY"
    return [O.parse_dates("msgs", "pd"), """ext0 AS (
          SELECT count(*) AS n_dated, min(p_ts) AS earliest_ts, max(p_ts) AS latest_ts,
                 first(p_local ORDER BY p_ts, ord) AS earliest_local,
                 first(p_local ORDER BY p_ts DESC, ord) AS latest_local FROM pd WHERE p_ok)""", f"""ext AS (
          SELECT *,
                 CASE WHEN n_dated > 0 THEN '## ' || strftime(earliest_local, '%B %d') || ' to '
                      || strftime(latest_local, '%B %d, %Y, %H:%M') || ' (summary run at {run_s})'
                      ELSE '## Week of ' || strftime({fb}, '%B %d') || ' to '
                      || strftime(TIMESTAMP '{C.RUN_TS}', '%B %d, %Y, %H:%M') || ' (summary run at {run_s})' END AS range_line,
                 '{C.RUN_TS:%Y%m%d_%H%M}_from_' || strftime(CASE WHEN n_dated > 0 THEN earliest_local ELSE {fb} END,
                                                          '%Y%m%d') AS stem
          FROM ext0)"""]


def latest_ctes() -> list[str]:
    hot = O.breaking("subject")
    cs, ss = O.clean_subject("subject"), O.short_sender("sender")
    return ["l AS (SELECT * FROM pd WHERE p_ok AND p_ts >= (SELECT max(p_ts) FROM pd WHERE p_ok) - INTERVAL 1 DAY)",
            f"""ll AS (
          SELECT ord, {cs} AS clean_subject, {ss} AS short_sender, {hot} AS breaking,
                 CASE WHEN {hot} THEN '- {cfg.REPORT_HOT_MARK} **' || {cs} || '** (via ' || {ss} || ')'
                      ELSE '- ' || {cs} || ' (via ' || {ss} || ')' END AS line FROM l)"""]


def _lit_rows(section: int, lines: list[str], part: int = 0, where: str = "") -> list[str]:
    return [f"SELECT {section} AS section_ord, CAST({part} AS BIGINT) AS part_ord, CAST({i} AS BIGINT) AS line_ord, "
            f"{O.q(ln)} AS line {where}" for i, ln in enumerate(lines)]


def report_sql(front: bool, model_label: str | None, model_ts: str | None, latest: bool) -> str:
    ctes = resolved_ctes() + [SEQ] + extent_ctes()[0:] + latest_ctes()
    ctes += analysis_ctes()[2:]
    sel: list[str] = []
    if front:
        title = cfg.FRONT_MATTER_TITLE.format(date=C.RUN_TS.strftime("%B %d, %Y"))
        sel += _lit_rows(0, ["---", "layout: default", f"title: {title}", "---", ""])
    sel += _lit_rows(1, [cfg.REPORT_TITLE])
    if model_label:
        sel += _lit_rows(2, [cfg.REPORT_MODEL_LINE.format(model=model_label), ""])
    sel.append("SELECT 3, CAST(0 AS BIGINT), CAST(0 AS BIGINT), range_line FROM ext")
    sel += _lit_rows(3, [""], part=1)
    sel += _lit_rows(4, [cfg.REPORT_ANALYSIS_HEADING, ""])
    sel.append("SELECT 5, batch_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT), unnest(arr) "
               f"FROM (SELECT batch_id, string_split(text, {NL}) AS arr FROM an)")
    if latest:
        sel += _lit_rows(6, ["", cfg.REPORT_LATEST_HEADING, "", cfg.REPORT_LATEST_INTRO, ""],
                         where="WHERE EXISTS (SELECT 1 FROM ll)")
        sel.append("SELECT 6, CAST(1 AS BIGINT), CAST(ord AS BIGINT), line FROM ll")
    pre, rest = cfg.REPORT_SOURCES_INTRO.split("{n}")
    mid, post = rest.split("{s}")
    sel += _lit_rows(7, [cfg.REPORT_SOURCES_HEADING, ""])
    sel.append(f"SELECT 7, CAST(1 AS BIGINT), CAST(0 AS BIGINT), {O.q(pre)} || CAST(count(*) AS VARCHAR) || {O.q(mid)} "
               f"|| CAST(count(DISTINCT sender) AS VARCHAR) || {O.q(post)} FROM msgs")
    sel += _lit_rows(7, [""], part=2)
    sel.append("SELECT 8, CAST(0 AS BIGINT), CAST(rank AS BIGINT), line FROM slines")
    meth = cfg.REPORT_METHODOLOGY
    if model_label and model_ts:
        ts = dt.datetime.fromisoformat(model_ts).strftime("%Y-%m-%d %H:%M:%S")
        meth += cfg.REPORT_METHODOLOGY_MODEL.format(model=model_label, ts=ts)
    sel += _lit_rows(9, ["", cfg.REPORT_METHODOLOGY_HEADING, meth])
    body = "\nUNION ALL ".join(sel)
    q = _with(*ctes) + f"SELECT * FROM ({body}) rows"
    return q


def topic_rounds_sql(rounds: int = 8) -> str:
    """The batches' counts of subjects, cut to the first topics, then summed
    and cut again for each ten neighbours; a last batch stays as it is."""
    top = f"QUALIFY row_number() OVER (PARTITION BY report_id, b ORDER BY k DESC, title) <= {cfg.DEFAULT_NUM_TOPICS}"
    ctes = ["""m AS (SELECT conv_id * 1000 + turn AS ord, role, split_part(text, ' ', 1) AS subject FROM conversations)""",
            "r AS (SELECT 0 AS report_id, ord, subject FROM m UNION ALL SELECT 1, ord, subject FROM m WHERE starts_with(role, 'user'))",
            f"s AS (SELECT report_id, subject, (row_number() OVER (PARTITION BY report_id ORDER BY ord) - 1) // {B} AS b FROM r)",
            f"""t0 AS (SELECT report_id, b, subject AS title, count(*) AS k FROM s
            WHERE {O.strip('subject')} <> '' GROUP BY report_id, b, subject {top})"""]
    ctes += [f"""t{i} AS (SELECT report_id, b, title, CAST(sum(n) AS BIGINT) AS k
            FROM (SELECT report_id, b // {cfg.MERGE_FAN_IN} AS b, title, k AS n FROM t{i - 1}) GROUP BY report_id, b, title {top})"""
             for i in range(1, rounds + 1)]
    return _with(*ctes) + f"""SELECT CAST(report_id AS BIGINT) AS report_id,
            row_number() OVER (PARTITION BY report_id ORDER BY k DESC, title) - 1 AS pos, title, k AS mentions FROM t{rounds}"""


def provider_values() -> str:
    rows = ", ".join("(" + ", ".join(O.q(v) for v in r) + ")" for r in cfg.PROVIDER_MODELS)
    return f"pm AS (SELECT * FROM (VALUES {rows}) AS t(provider, routed_model, model_label, direct_model))"


def oracle_queries() -> dict[str, str]:
    hot = O.breaking("subject")
    cs, ss = O.clean_subject("subject"), O.short_sender("sender")
    url_rx = O.q(O.URL_RX)
    block = O.q(_rx(cfg.BODY_URL_BLOCKLIST))
    cutoff_b1 = dt.datetime.combine(C.RUN_TS.date() - dt.timedelta(days=C.DAYS), dt.time())
    title_rx = O.q(O.TITLE_RX)
    head = O.q(PROMPT_HEAD.format(n=cfg.DEFAULT_NUM_TOPICS))
    direct_openai, direct_other = cfg.PROVIDER_MODELS[1][3], cfg.PROVIDER_MODELS[0][3]
    q = {
        "issues_per_source": _with(O.MSGS, """g AS (
              SELECT sender, count(*) AS issues, min(ord) AS first_ord, arg_min(subject, ord) AS first_subject,
                     arg_min(date, ord) AS first_date FROM msgs GROUP BY sender)""") + f"""
            SELECT sender, {O.sender_name('sender')} AS name, {O.sender_email('sender')} AS email, issues, first_ord,
                   row_number() OVER (ORDER BY issues DESC, first_ord) AS rank, first_subject, first_date FROM g""",
        "issues_ties": _with(O.MSGS, """d AS (
            SELECT sender, CASE WHEN label <> 'error' THEN date_diff('day', DATE '1970-01-01', CAST(event_ts AS DATE)) END AS o FROM msgs)""") +
            "SELECT sender, count(*) AS issues, min(o) AS first_ord, CAST(1 AS BIGINT) AS n_rows FROM d GROUP BY sender",
        "source_totals": _with(O.MSGS) + "SELECT count(*) AS n_messages, count(DISTINCT sender) AS n_sources FROM msgs",
        "date_extent": _with(O.MSGS, *extent_ctes()) + f"""
            SELECT n_dated, strftime(earliest_ts, '{TS_SQL}') AS earliest_ts, strftime(latest_ts, '{TS_SQL}') AS latest_ts,
                   strftime(earliest_local, '{TS_SQL}') AS earliest_local, strftime(latest_local, '{TS_SQL}') AS latest_local,
                   range_line, stem, '{cfg.REPORT_FILE_PREFIX}' || stem || '.md' AS file_name FROM ext""",
        "rfc2822_dates": _with(O.MSGS, O.parse_dates("msgs", "pd")) + f"""
            SELECT ord, date, p_ok AS date_ok, strftime(p_ts, '{TS_SQL}') AS ts_utc,
                   strftime(p_local, '{TS_SQL}') AS local_ts, p_off AS offset_s, p_tz_known AS tz_known FROM pd""",
        "latest_24h": _with(O.MSGS, O.parse_dates("msgs", "pd"), *latest_ctes()) + "SELECT * FROM ll",
        "breaking_flag": _with(O.MSGS) + f"SELECT ord, subject, {hot} AS breaking FROM msgs",
        "sender_parse": _with(O.MSGS, "sd AS (SELECT DISTINCT sender FROM msgs)") + f"""
            SELECT sender, {O.sender_name('sender')} AS name, {O.sender_email('sender')} AS email,
                   {O.short_sender('sender')} AS short_sender, lower({O.strip(O.sender_name('sender'))}) AS key,
                   {O.normalize(O.sender_name('sender'))} AS norm, {O.email_domain(O.sender_email('sender'))} AS domain
            FROM sd""",
        "select_messages": _with(O.MSGS) + f"""
            SELECT ord, msg_id, label, strftime(event_ts, '{TS_SQL}') AS received_ts FROM msgs
            WHERE event_ts >= TIMESTAMP '{cutoff_b1}' AND label = '{C.LABEL}'""",
        "select_by_address": _with(O.MSGS) + f"""
            SELECT ord, msg_id, sender, recipient FROM msgs
            WHERE coalesce({O.sender_email('recipient')}, recipient) = '{C.TO_EMAIL}'""",
        "message_parse": _with(O.MSGS, f"""x AS (
              SELECT *, CASE WHEN label IN ('view', 'click') THEN body
                             WHEN label = 'signup' THEN subject || {NL} || recipient
                             WHEN label = 'purchase' THEN subject ELSE '' END AS b,
                        CASE WHEN label IN ('view', 'click') THEN 'html'
                             WHEN label IN ('signup', 'purchase') THEN 'plain' END AS fmt FROM msgs)""") + f"""
            SELECT msg_id, label AS labels, CASE WHEN label = 'error' THEN '{cfg.NO_SUBJECT}' ELSE subject END AS subject,
                   date, sender, recipient, md5(b) AS body_md5, length(b) AS body_chars, fmt AS body_format,
                   true AS decode_ok FROM x""",
        "clean_html": f"SELECT page_id, {O.clean_body('html')} AS cleaned FROM pages",
        # the markdown that the adapter's markup stands for, built from the lines
        "clean_markup": f"""WITH p AS (
              SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), {NL}),
                lambda x: trim(regexp_replace(regexp_replace(x, '[^a-z ]', '', 'g'), ' +', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
            d AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE ['none'] END AS l FROM p)
            SELECT doc_id, '## ' || l[1] || {NL} || {NL} || 'by **' || l[1] || '** and *' || l[-1] || '*' || {NL} || '1. ' || l[1] || {NL} || '   * '
              || array_to_string(l, {NL} || '   * ') || {NL} || '2. **' || l[-1] || '**' || {NL} || {NL} || '> ' || l[1] || {NL} || '>' || {NL} || '> ' || l[-1]
              || {NL} || {NL} || '| line | text |' || {NL} || '| --- | --- |' || {NL}
              || array_to_string(list_transform(range(1, len(l) + 1), lambda i: '| ' || i || ' | ' || l[i] || ' |'), {NL})
              || {NL} || {NL} || 'éé€… <b> &unknown;' AS cleaned FROM d""",
        "strip_css": f"SELECT page_id, {O.strip_css('html')} AS stripped FROM pages",
        "cost_rollup": _with(*rollup_ctes()) + "SELECT level, key, runs, tokens, round(cost, 6) AS cost, first_ord FROM g",
        "cost_shares": _with(*rollup_ctes(), "t AS (SELECT * FROM g WHERE level = 'total')") + """
            SELECT level, key, runs, tokens, first_ord, round(cost, 6) AS cost,
                   round(CASE WHEN level = 'total' THEN (CASE WHEN runs > 0 THEN cost / runs ELSE 0.0 END) END, 6)
                     AS avg_cost_per_run,
                   round(CASE WHEN level <> 'total' THEN (CASE WHEN (SELECT cost FROM t) <> 0
                         THEN cost / (SELECT cost FROM t) * 100 ELSE 0.0 END) END, 6) AS pct_cost,
                   round(CASE WHEN level = 'provider' THEN CAST(runs AS DOUBLE) / nullif((SELECT runs FROM t), 0) * 100 END, 6)
                     AS pct_runs,
                   round(CASE WHEN level = 'provider' THEN CAST(tokens AS DOUBLE) / nullif((SELECT tokens FROM t), 0) * 100 END, 6)
                     AS pct_tokens,
                   round(CASE WHEN level <> 'total' AND tokens <> 0 THEN cost / tokens * 1000 END, 6) AS cost_per_1k
            FROM g""",
        "cost_lookback": _with(COST_LOG) + f"""SELECT ord, timestamp, provider, model FROM c
            WHERE coalesce(timestamp, '') >= '{(C.RUN_TS - dt.timedelta(days=C.DAYS)).isoformat()}'""",
        "cost_log_appends": _with(COST_LOG, f"""w AS (
              SELECT coalesce(provider, 'unknown') AS provider, coalesce(model, 'unknown') AS model, coalesce(total_tokens, 0) AS tk,
                     (3 - ord % 4) * 1000000000000 + ord AS p FROM c
              WHERE coalesce(timestamp, '') >= '{(C.RUN_TS - dt.timedelta(days=C.COST_DAYS)).isoformat()}')""", """g AS (
              SELECT 'total' AS level, NULL AS key, count(*) AS runs, CAST(sum(tk) AS BIGINT) AS tokens, min(p) AS p FROM w
              UNION ALL SELECT 'provider', provider, count(*), CAST(sum(tk) AS BIGINT), min(p) FROM w GROUP BY provider
              UNION ALL SELECT 'model', model, count(*), CAST(sum(tk) AS BIGINT), min(p) FROM w GROUP BY model)""") + """
            SELECT level, key, runs, tokens, row_number() OVER (PARTITION BY level ORDER BY p) AS place FROM g""",
        "json_records": f"""
            SELECT dense_rank() OVER (ORDER BY conv_id // 64) - 1 AS file_no, row_number() OVER (PARTITION BY conv_id // 64 ORDER BY conv_id, turn) - 1 AS place,
                   '{{' || role AS subject, role || ' <a@b.c>' AS sender, CAST(conv_id AS VARCHAR) AS date,
                   md5(text || CASE WHEN turn % 2 = 0 THEN {NL} || '"}}], {{\\" [' ELSE '}}\\\\' END) AS body_md5 FROM conversations""",
        "body_urls": _with(O.MSGS) + f"""
            SELECT ord, len(coalesce(regexp_extract_all(body, {url_rx}, 0), [])) AS n_urls,
                   array_to_string(list_filter(coalesce(regexp_extract_all(body, {url_rx}, 0), []),
                       lambda u: NOT regexp_matches(u, {block})), ' ') AS kept_urls FROM msgs""",
        "homepage_pick": _with(O.MSGS) + f"SELECT ord, {O.homepage_from_body('body')} AS homepage FROM msgs",
        "homepage_resolve": _with(*resolved_ctes()) + "SELECT * FROM res",
        "registry_merge": _with(*resolved_ctes(), """nw AS (
              SELECT key AS name, arg_max(url, rank) AS url, arg_max(verified, rank) AS verified
              FROM res WHERE url IS NOT NULL AND length(url) > 0 GROUP BY key)""") + """
            SELECT coalesce(nw.name, reg.name) AS name,
                   CASE WHEN nw.name IS NOT NULL THEN nw.url ELSE reg.url END AS url,
                   CASE WHEN nw.name IS NOT NULL THEN nw.verified ELSE reg.verified END AS verified
            FROM reg FULL OUTER JOIN nw ON reg.name = nw.name""",
        "source_lines": _with(*resolved_ctes()) + "SELECT rank, line FROM slines",
        "registry_quality": _with(*errors_ctes()) + "SELECT * FROM errs",
        "quality_rollup": _with(*errors_ctes()) + f"""
            SELECT '{cfg.REGISTRY_CATEGORY}' AS category, count(*) = 0 AS is_valid, count(*) AS n_errors FROM errs""",
        "quality_report": report_errors_sql(),
        "review_queue": _with(O.PAGE_SITE, REGISTRY) + "SELECT name, url FROM reg WHERE NOT coalesce(verified, false)",
        "review_apply": _with(O.PAGE_SITE, REGISTRY, DECISIONS, f"""j AS (
              SELECT reg.*, CASE WHEN NOT coalesce(reg.verified, false) THEN lower({O.strip('dec.action')}) END AS act,
                     dec.new_url FROM reg LEFT JOIN dec USING (name))""") + f"""
            SELECT name, CASE WHEN act = 'e' THEN {O.strip('new_url')} ELSE url END AS url,
                   CASE WHEN act IN ('a', 'e') THEN true ELSE verified END AS verified,
                   coalesce(act IN ('a', 'e'), false) AS changed
            FROM j WHERE coalesce(act <> 'd', true)""",
        "review_summary": _with(O.PAGE_SITE, REGISTRY, DECISIONS, f"""j AS (
              SELECT lower({O.strip('dec.action')}) AS act FROM reg JOIN dec USING (name)
              WHERE NOT coalesce(reg.verified, false))""") + """
            SELECT count(*) FILTER (WHERE act = 'a') AS n_accepted, count(*) FILTER (WHERE act = 'e') AS n_edited,
                   count(*) FILTER (WHERE act = 'd') AS n_deleted,
                   count(*) FILTER (WHERE act IN ('a', 'e', 'd')) > 0 AS changed FROM j""",
        "prompt_blocks": _with(*items_ctes()) + "SELECT * FROM items",
        "prompt_pack": _with(*items_ctes()) + f"""
            SELECT batch_id, count(*) AS n_items, {head} || string_agg(block, {NL} ORDER BY item_no) || {NL} AS prompt
            FROM items GROUP BY batch_id""",
        "prompt_budget": _with(*budget_ctes(C.PROMPT_CHARS)) + f"""
            SELECT ord, batch_id, item_no,
                   'NEWSLETTER #' || CAST(item_no AS VARCHAR) || {NL} || 'SUBJECT: ' || coalesce(subject, 'None') || {NL}
                   || 'SENDER: ' || coalesce(sender, 'None') || {NL} || 'DATE: ' || coalesce(date, 'None') || {NL}
                   || 'CONTENT:' || {NL} || content || {NL} || {NL} AS block FROM b4""",
        "topic_titles": f"""WITH a AS (
              SELECT doc_id, CASE WHEN lang = 'de' THEN '  ' ELSE '' END || '### ' || CAST(doc_id AS VARCHAR) || '. '
                     || text AS analysis FROM documents),
            t AS (SELECT doc_id, regexp_extract_all(analysis, {title_rx}, 1) AS arr FROM a)
            SELECT doc_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS pos, unnest(arr) AS title FROM t""",
        "route_models": _with(f"""r AS (
              SELECT event_id,
                     CASE event_type WHEN 'view' THEN 'openai' WHEN 'click' THEN 'claude' WHEN 'signup' THEN 'google'
                          WHEN 'purchase' THEN 'mistral' ELSE 'openai' END AS provider,
                     CASE WHEN event_type = 'error' THEN 'custom/model-' || regexp_extract(props, '[0-9]', 0) END
                       AS custom_model FROM events)""", provider_values(), """x AS (
              SELECT r.*, pm.routed_model, pm.model_label AS pm_label,
                     coalesce(r.custom_model IS NOT NULL AND length(r.custom_model) > 0, false) AS has_custom
              FROM r LEFT JOIN pm USING (provider))""") + f"""
            SELECT event_id, provider, custom_model,
                   CASE WHEN has_custom THEN custom_model ELSE routed_model END AS model,
                   CASE WHEN has_custom THEN custom_model ELSE coalesce(pm_label, '{cfg.UNKNOWN_MODEL_LABEL}') END AS model_label,
                   CASE WHEN provider = 'openai' THEN '{direct_openai}' ELSE '{direct_other}' END AS direct_model,
                   CASE WHEN has_custom THEN '{cfg.CUSTOM_PROVIDER}' ELSE provider END AS log_provider,
                   CASE WHEN (CASE WHEN has_custom THEN custom_model ELSE routed_model END) IS NULL
                        THEN 'unknown_provider' ELSE 'ok' END AS route_status
            FROM x""",
        "usage_rows": f"""
            SELECT conv_id, turn, '{C.MODEL}' AS model, 'openai' AS log_provider, '{C.RUN_TS.isoformat()}' AS timestamp,
                   CAST(turn AS BIGINT) AS prompt_tokens, CAST(length(text) AS BIGINT) AS completion_tokens,
                   CAST(length(text) + turn AS BIGINT) AS total_tokens, round(length(text) / 1000.0, 6) AS cost
            FROM conversations WHERE role = 'assistant' AND turn > 1""",
        "response_topics": f"""
            SELECT conv_id, turn, len(regexp_extract_all(text, {title_rx}, 1)) AS n_titles, length(text) AS text_chars
            FROM conversations WHERE role = 'assistant'""",
        "score_stub": _with(*analysis_ctes()) + f"""
            SELECT batch_id, 'ok' AS status, 1 AS attempt, '{C.MODEL}' AS model,
                   len(regexp_extract_all(text, {title_rx}, 1)) AS n_topics,
                   regexp_extract_all(text, {title_rx}, 1)[1] AS first_topic FROM an""",
        "report_topics": topic_rounds_sql(),
        "report_sections": report_sql(True, C.MODEL_LABEL, C.MODEL_TS, True),
        "stream_ingest": _with(O.MSGS, f"""x AS (
              SELECT *, CASE WHEN label IN ('view', 'click') THEN body
                             WHEN label = 'signup' THEN subject || {NL} || recipient
                             WHEN label = 'purchase' THEN subject ELSE '' END AS b,
                        CASE WHEN label IN ('view', 'click') THEN 'html'
                             WHEN label IN ('signup', 'purchase') THEN 'plain' END AS fmt FROM msgs)""") + f"""
            SELECT msg_id, CASE WHEN label = 'error' THEN '{cfg.NO_SUBJECT}' ELSE subject END AS subject,
                   fmt AS body_format, true AS decode_ok, md5(b) AS body_md5, md5({O.clean_body('b')}) AS cleaned_md5
            FROM x""",
        "stream_cost": _with(COST_LOG) + f"""
            SELECT strftime(date_trunc('day', CAST(timestamp AS TIMESTAMP)), '{TS_SQL}') AS window_start,
                   coalesce(provider, 'unknown') AS provider, count(*) AS runs,
                   CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens, round(sum(coalesce(cost, 0)), 6) AS cost
            FROM c GROUP BY 1, 2""",
        "stream_quarantine": _with(O.MSGS) + f"""
            SELECT CASE WHEN label <> 'error' THEN msg_id END AS msg_id,
                   CASE label WHEN 'signup' THEN 'undecodable body' WHEN 'error' THEN 'not a message' ELSE 'message' END AS kind,
                   CASE WHEN label IN ('view', 'click') THEN md5({O.clean_body('body')})
                        WHEN label = 'purchase' THEN md5({O.clean_body('subject')}) END AS content_md5 FROM msgs""",
        "stream_cost_levels": _with(COST_LOG, """p AS (
              SELECT *, CAST(timestamp AS TIMESTAMP) AS t, day(CAST(timestamp AS TIMESTAMP)) // 8 AS wk FROM c)""", """x AS (
              SELECT *, coalesce(wk = 0 AND date_trunc('day', t) + INTERVAL 1 DAY <= (SELECT max(t) FROM p WHERE wk IN (1, 2)) - INTERVAL 48 HOUR, false) AS late FROM p)""", """k AS (
              SELECT t, 'provider' AS level, coalesce(provider, 'unknown') AS key, total_tokens, cost FROM x WHERE NOT late
              UNION ALL SELECT t, 'model', coalesce(model, 'unknown'), total_tokens, cost FROM x WHERE NOT late)""") + f"""
            SELECT strftime(date_trunc('day', t), '{TS_SQL}') AS window_start, level, key, count(*) AS runs,
                   CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens, round(sum(coalesce(cost, 0)), 6) AS cost FROM k GROUP BY 1, 2, 3
            UNION ALL SELECT NULL, 'late', 'late', count(*), CAST(sum(total_tokens) AS BIGINT), round(sum(cost), 6) FROM x WHERE late HAVING count(*) > 0""",
        "report_no_latest": report_sql(False, None, None, False),
    }
    # S3 runs the batch operators on one micro-batch of message resources;
    # receipt order equals event order, bodies follow the resource layout.
    q["stream_registry"] = _with(*resolved_ctes(RESOURCE_BODY), """nw AS (
              SELECT key AS name, arg_max(url, rank) AS url, arg_max(verified, rank) AS verified
              FROM res WHERE url IS NOT NULL AND length(url) > 0 GROUP BY key)""") + """
            SELECT coalesce(nw.name, reg.name) AS name,
                   CASE WHEN nw.name IS NOT NULL THEN nw.url ELSE reg.url END AS url,
                   CASE WHEN nw.name IS NOT NULL THEN nw.verified ELSE reg.verified END AS verified
            FROM reg FULL OUTER JOIN nw ON reg.name = nw.name"""
    return q
