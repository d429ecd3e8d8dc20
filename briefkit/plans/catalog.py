"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables through ``briefkit.sources.tables``
(whole tables, whole texts) and runs the engine's operators on them.
Computed columns carry the same names as in ``plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import clean_body, clean_columns, strip_css, strip_elements
from ..functions.markdown import clean_markdown
from .. import config as cfg
from ..functions.responses import topic_titles, topics
from ..functions.text import (email_domain, is_breaking, normalize, registry_key, sender_email, sender_name,
                              short_sender)
from ..functions.urls import drop_tracking, extract_urls, homepage_from_body
from ..operators import costs, digest, prompts, quality, review, scoring, sites, stats
from ..operators.parse import parse_messages
from ..operators.select import cost_lookback, select_messages
from ..session import children, scratch_path
from ..sources import tables as T
from ..sources.costlog import append_cost_rows, compact_cost_log, good_rows, read_cost_log
from ..sources.messages import read_records_json, to_message_resources
from . import report as R

# Run parameters (the clock is a parameter, never read inside operators).
RUN_TS = dt.datetime(2024, 1, 31, 9, 30)
DAYS = 7
COST_DAYS = 30
LABEL = "click"
TO_EMAIL = "reader9@inbox.example.org"
MODEL = "openai/gpt-4.1-mini"
MODEL_LABEL = "gpt-4.1-2025-04-14"
MODEL_TS = "2024-01-31T09:29:41.123456"
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _ts(c) -> Column:
    return F.date_format(c, TS_FMT)


def _r(c, n: int = 6) -> Column:
    return F.round(c, n)


# ---------------------------------------------------------------- messages
def issues_per_source(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.issues_per_source(T.records(spark, sf))
    return s.select("sender", sender_name(F.col("sender")).alias("name"), sender_email(F.col("sender")).alias("email"),
                    "issues", "first_ord", "rank", F.col("first.subject").alias("first_subject"),
                    F.col("first.date").alias("first_date"))


def issues_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Records that share their place: ``ord`` is the day, NULL for errors,
    and the message id (here the event number) decides."""
    m = T.messages(spark, sf)
    recs = m.select(F.when(F.col("label") != "error", F.unix_date(F.to_date("received_ts")).cast("long")).alias("ord"),
                    "subject", "date", "sender", "body")
    s = stats.issues_per_source(recs)
    return s.select("sender", "issues", "first_ord", F.count(F.lit(1)).over(Window.partitionBy("sender")).alias("n_rows"))


def source_totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.source_totals(T.records(spark, sf))


def date_extent(spark: SparkSession, sf: str) -> DataFrame:
    e = stats.range_label(stats.date_extent(stats.parse_dates(T.records(spark, sf))), RUN_TS, DAYS)
    return e.select("n_dated", _ts("earliest_ts").alias("earliest_ts"), _ts("latest_ts").alias("latest_ts"),
                    _ts("earliest_local").alias("earliest_local"), _ts("latest_local").alias("latest_local"),
                    "range_line", "stem", "file_name")


def rfc2822_dates(spark: SparkSession, sf: str) -> DataFrame:
    p = stats.parse_dates(T.records(spark, sf))
    return p.select("ord", "date", "date_ok", _ts("ts").alias("ts_utc"), _ts("local_ts").alias("local_ts"),
                    "offset_s", "tz_known")


def latest_24h(spark: SparkSession, sf: str) -> DataFrame:
    return stats.latest_lines(stats.latest_slice(stats.parse_dates(T.records(spark, sf))))


def breaking_flag(spark: SparkSession, sf: str) -> DataFrame:
    return T.records(spark, sf).select("ord", "subject", is_breaking(F.col("subject")).alias("breaking"))


def sender_parse(spark: SparkSession, sf: str) -> DataFrame:
    s = T.records(spark, sf).select("sender").distinct()
    name, email = sender_name(F.col("sender")), sender_email(F.col("sender"))
    return s.select("sender", name.alias("name"), email.alias("email"),
                    short_sender(F.col("sender")).alias("short_sender"), registry_key(name).alias("key"),
                    normalize(name).alias("norm"), email_domain(email).alias("domain"))


def _with_labels(spark, sf):
    return T.messages(spark, sf).withColumn("labels", F.array("label"))


def select_messages_q(spark: SparkSession, sf: str) -> DataFrame:
    m = select_messages(_with_labels(spark, sf), as_of=RUN_TS, days=DAYS, label=LABEL)
    return m.select("ord", "msg_id", "label", _ts("received_ts").alias("received_ts"))


def select_by_address(spark: SparkSession, sf: str) -> DataFrame:
    m = select_messages(_with_labels(spark, sf), to_email=TO_EMAIL)
    return m.select("ord", "msg_id", "sender", "recipient")


def message_parse(spark: SparkSession, sf: str) -> DataFrame:
    res = to_message_resources(T.messages(spark, sf))
    p = parse_messages(res)
    return p.select("msg_id", F.array_join("labels", ",").alias("labels"), "subject", "date", "sender", "recipient",
                    F.md5(F.col("body")).alias("body_md5"), F.length("body").cast("bigint").alias("body_chars"), "body_format",
                    "decode_ok")


# ------------------------------------------------------------------ cleaning
def clean_html(spark: SparkSession, sf: str) -> DataFrame:
    p = T.spread(T.read_table(spark, sf, "pages"), "page_id")
    return p.select("page_id", clean_body(F.col("html")).alias("cleaned"))


def clean_markup(spark: SparkSession, sf: str) -> DataFrame:
    """Structured cleaning of nested lists, marks, quotes, tables, references
    and unclosed scripts."""
    return T.markup(spark, sf).select("doc_id", clean_markdown(F.col("html")).alias("cleaned"))


def css_strip(spark: SparkSession, sf: str) -> DataFrame:
    p = T.spread(T.read_table(spark, sf, "pages"), "page_id")
    return p.select("page_id", strip_css(strip_elements(F.col("html"))).alias("stripped"))


# ------------------------------------------------------------------- costs
def _rollup(spark, sf, days=COST_DAYS):
    return costs.cost_rollup(T.cost_log(spark, sf), RUN_TS, days)


def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    r = _rollup(spark, sf)
    return r.select("level", "key", "runs", "tokens", _r(F.col("cost")).alias("cost"), "first_ord")


def cost_shares(spark: SparkSession, sf: str) -> DataFrame:
    r = costs.cost_shares(_rollup(spark, sf))
    return r.select("level", "key", "runs", "tokens", "first_ord",
                    *[_r(F.col(c)).alias(c) for c in ("cost", "avg_cost_per_run", "pct_cost", "pct_runs",
                                                       "pct_tokens", "cost_per_1k")])


def cost_log_appends(spark: SparkSession, sf: str) -> DataFrame:
    """A4 + F12: the log's rows appended in four commits, the second of them
    compacted with the first; groups in the order of their first append."""
    log, root = T.cost_log(spark, sf), scratch_path(spark, "cost-log")
    for k in range(4):
        append_cost_rows(log.where(F.col("ord") % 4 == 3 - k), root, order="ord")
        if k == 1:
            compact_cost_log(spark, root)
    g = costs.cost_rollup(good_rows(read_cost_log(spark, root)), RUN_TS, COST_DAYS)
    place = F.row_number().over(Window.partitionBy("level").orderBy("first_ord"))
    return g.select("level", "key", "runs", "tokens", place.cast("bigint").alias("place"))


def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """A2: files that each hold one JSON array, read by ranges; the place of a
    record in its array becomes its order."""
    path = scratch_path(spark, "json-arrays")
    T.write_json_arrays(T.chat_records(spark, sf), path)
    r = read_records_json(spark, path)
    file_no, place = F.shiftright("ord", 40), F.col("ord").bitwiseAND((1 << 40) - 1)
    return r.select(file_no.alias("file_no"), place.alias("place"), "subject", "sender", "date", F.md5("body").alias("body_md5"))


def cost_lookback_q(spark: SparkSession, sf: str) -> DataFrame:
    return cost_lookback(T.cost_log(spark, sf), RUN_TS, DAYS).select("ord", "timestamp", "provider", "model")


# ------------------------------------------------------------------- sites
def body_urls(spark: SparkSession, sf: str) -> DataFrame:
    urls = extract_urls(F.col("body"))
    return T.records(spark, sf).select("ord", F.size(urls).cast("bigint").alias("n_urls"),
                                       F.array_join(drop_tracking(urls), " ").alias("kept_urls"))


def homepage_pick(spark: SparkSession, sf: str) -> DataFrame:
    return T.records(spark, sf).select("ord", homepage_from_body(F.col("body")).alias("homepage"))


def _resolved(spark, sf):
    src = stats.issues_per_source(T.records(spark, sf))
    return sites.resolve_homepages(src, T.registry(spark, sf), T.curated(spark, sf))


def homepage_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf)


def registry_merge(spark: SparkSession, sf: str) -> DataFrame:
    return sites.merge_registry(T.registry(spark, sf), _resolved(spark, sf))


def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sites.source_lines(_resolved(spark, sf))


# ---------------------------------------------------------------- registry
def _errors(spark, sf):
    return quality.registry_errors(quality.typed_entries(T.site_rows(spark, sf)))


def registry_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _errors(spark, sf)


def quality_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validation_rollup(_errors(spark, sf))


CATEGORIES = ["newsletter_websites", "untyped_entries", "registry", "curated_sites", "curated_names"]


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """the errors of several categories in file order, one flag for each
    and one for all: the pages' sites, entries of the wrong types (I1, I3–I6,
    I11), the registry, and the curated list with and without its urls."""
    reg = T.page_sites(spark, sf).groupBy(F.col("site").alias("name")).agg(F.min("page_id").alias("ord"), F.min("url").alias("url"))
    cur = T.curated(spark, sf).withColumn("verified", F.lit(True))
    blank = cur.select("ord", F.concat(F.lit(" "), F.col("name")).alias("name"), F.lit(None).cast("string").alias("url"), "verified")
    typed = [quality.typed_entries(t) for t in (T.site_rows(spark, sf), reg.withColumn("verified", F.col("url").startswith("https://")), cur, blank)]
    entries = [typed[0], quality.variant_entries(T.untyped_entries(spark, sf)), *typed[1:]]
    errors = [quality.registry_errors(e).withColumn("category", F.lit(c)) for c, e in zip(CATEGORIES, entries)]
    return quality.validation_report(reduce(DataFrame.unionByName, errors), CATEGORIES)


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_queue(T.registry(spark, sf))


def review_apply(spark: SparkSession, sf: str) -> DataFrame:
    reg = T.registry(spark, sf)
    return review.apply_decisions(reg, T.decisions(reg))


def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    reg = T.registry(spark, sf)
    return review.review_summary(reg, T.decisions(reg))


# ------------------------------------------------------------------ prompts
def prompt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.prompt_items(T.records(spark, sf))


def prompt_pack(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.pack_prompts(prompts.prompt_items(T.records(spark, sf), clean=clean_columns, ranges=True))


PROMPT_CHARS = 20_000


def prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    """E2 with a character budget instead of an item count."""
    return prompts.prompt_items(T.records(spark, sf), batch_chars=PROMPT_CHARS)


def topic_titles_q(spark: SparkSession, sf: str) -> DataFrame:
    a = T.analyses(spark, sf)
    return a.select("doc_id", F.posexplode(topic_titles(F.col("analysis"))).alias("pos", "title"))


def _requests(spark, sf):
    e = T.read_table(spark, sf, "events")
    et = F.col("event_type")
    provider = (F.when(et == "view", "openai").when(et == "click", "claude").when(et == "signup", "google")
                .when(et == "purchase", "mistral").otherwise("openai"))
    custom = F.when(et == "error", F.concat(F.lit("custom/model-"), F.regexp_extract("props", "[0-9]", 0)))
    return e.select("event_id", provider.alias("provider"), custom.alias("custom_model"))


def route_models(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.route_models(_requests(spark, sf), prompts.provider_models(spark))


def usage_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = T.responses(spark, sf).withColumn("model", F.lit(MODEL)).withColumn("log_provider", F.lit("openai"))
    u = prompts.usage_rows(r, RUN_TS)
    return u.select("conv_id", "turn", "model", "log_provider", "timestamp", "prompt_tokens", "completion_tokens",
                    "total_tokens", _r(F.col("cost")).alias("cost"))


def response_topics(spark: SparkSession, sf: str) -> DataFrame:
    c = prompts.response_content(T.responses(spark, sf))
    return c.select("conv_id", "turn", F.size(topic_titles(F.col("text"))).cast("bigint").alias("n_titles"),
                    F.length("text").cast("bigint").alias("text_chars"))


def _scored(spark, sf):
    packed = prompts.pack_prompts(prompts.prompt_items(T.records(spark, sf), ranges=True))
    return scoring.score_prompts(packed, MODEL)


def score_stub(spark: SparkSession, sf: str) -> DataFrame:
    s = prompts.response_content(_scored(spark, sf))
    t = topic_titles(F.col("text"))
    return s.select("batch_id", "status", "attempt", "model", F.size(t).cast("bigint").alias("n_topics"),
                    F.get(t, 0).alias("first_topic"))


def report_topics(spark: SparkSession, sf: str) -> DataFrame:
    """E2 + E3: one list of topics for each of two reports, of all messages of
    the conversations and of their users', merged from the replies to all
    batches."""
    m = T.chat_messages(spark, sf)
    packed = [prompts.pack_prompts(prompts.prompt_items(x, ranges=True)).select(F.lit(i).cast("long").alias("report_id"), "batch_id", "prompt")
              for i, x in enumerate((m, m.where(F.col("sender").startswith("user"))))]
    score = partial(scoring.score_once, model=MODEL, ledger=scratch_path(spark, "ledger"),
                    client_factory=partial(scoring.TopicClient, cfg.DEFAULT_NUM_TOPICS))
    replies = prompts.response_content(score(packed[0].unionByName(packed[1]))).select("report_id", "batch_id", "text")
    final, _ = digest.one_reply(replies, score)
    t = final.select("report_id", F.posexplode(topics(F.col("text"))).alias("pos", "t"))
    mentions = F.regexp_extract("t.body", r"Mentions:\*\* (\d+)", 1).cast("bigint")
    return t.select("report_id", F.col("pos").cast("bigint").alias("pos"), F.col("t.title").alias("title"), mentions.alias("mentions"))


def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    recs = T.records(spark, sf)
    analysis = prompts.response_content(_scored(spark, sf)).select("batch_id", "text")
    p = R.ReportParams(run_ts=RUN_TS, days=DAYS, model_label=MODEL_LABEL, model_ts=MODEL_TS, front_matter=True)
    return R.build_report(recs, analysis, T.registry(spark, sf), T.curated(spark, sf), p)


def report_no_latest(spark: SparkSession, sf: str) -> DataFrame:
    recs = T.records(spark, sf)
    analysis = prompts.response_content(_scored(spark, sf)).select("batch_id", "text")
    p = R.ReportParams(run_ts=RUN_TS, days=DAYS, include_latest=False)
    return R.build_report(recs, analysis, T.registry(spark, sf), T.curated(spark, sf), p)


# --------------------------------------------------------------- streaming
MICRO_BATCHES = 4


#: Most rows of a stream's file.  Files are compressed and a task reads some 30
#: of them at once, whose rows it sorts by day.
FILE_ROWS = 5_000


def _files(rows: DataFrame, spark: SparkSession, sf: str, as_format: str, src: str) -> None:
    """Append rows to a stream's source where they are: no task gathers a file,
    and a file, compressed, holds a 32nd of the events at most."""
    most = min(T.read_table(spark, sf, "events").count() // 32 + 1, FILE_ROWS)
    rows.write.mode("append").format(as_format).option("compression", "gzip").option("maxRecordsPerFile", most).save(src)


def _per_trigger(spark: SparkSession, src: str) -> int:
    """Files a micro-batch, so that there are ``MICRO_BATCHES``."""
    return -(-sum(n.startswith("part-") for n in children(spark, src)) // MICRO_BATCHES) or 1


def _stream_source(spark, sf):
    """Message resources derived from the tables, written as JSON files
    under the shared checkpoint folder (the stream's input)."""
    src = scratch_path(spark, "stream-src")
    _files(to_message_resources(T.messages(spark, sf)), spark, sf, "json", src)
    return src


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import pipelines as S
    src, sink, ck = _stream_source(spark, sf), scratch_path(spark, "s1-out"), scratch_path(spark, "s1-ckpt")
    S.ingest_stream(spark, src, sink, ck, max_files_per_trigger=_per_trigger(spark, src), clean=clean_body).awaitTermination()
    return spark.read.parquet(sink).select("msg_id", "subject", "body_format", "decode_ok", "body_md5",
                                           F.md5("cleaned").alias("cleaned_md5"))


def stream_cost(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import pipelines as S
    src, sink, ck = scratch_path(spark, "s2-src"), scratch_path(spark, "s2-out"), scratch_path(spark, "s2-ckpt")
    T.cost_log(spark, sf).drop("ord").repartitionByRange(4, "timestamp").write.json(src)
    S.cost_stream(spark, src, sink, ck).awaitTermination()
    w = S.read_cost_windows(spark, sink)
    return w.select(_ts("window_start").alias("window_start"), "provider", "runs", "tokens",
                    _r(F.col("cost")).alias("cost"))


def stream_registry(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import pipelines as S
    src, root, ck = _stream_source(spark, sf), scratch_path(spark, "s3-reg"), scratch_path(spark, "s3-ckpt")
    initial = scratch_path(spark, "s3-initial")
    T.registry(spark, sf).write.parquet(initial)
    S.registry_stream(spark, src, root, ck, curated=T.curated(spark, sf), initial=initial, max_files_per_trigger=_per_trigger(spark, src),
                      compact_every=3).awaitTermination()
    return S.latest_registry(spark, root)


def _resent(spark: SparkSession, sf: str) -> str:
    """Files of messages, of which some come again in a later file and some
    are broken: every purchase is sent twice, signups have a body that is no
    base64, lines of errors are cut in half."""
    src = scratch_path(spark, "s1-resent")
    res = to_message_resources(T.messages(spark, sf))
    label = F.get("labelIds", 0)
    wrong = res.withColumn("payload", F.when(label == "signup", F.col("payload").withField(
        "parts", F.transform("payload.parts", lambda p: p.withField("body", F.struct(F.lit("%%%").alias("data")))))).otherwise(F.col("payload")))
    line = F.to_json(F.struct(*wrong.columns))
    lines = wrong.select(label.alias("label"), F.when(label == "error", F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line).alias("line"))
    for part in (lines, lines.where("label = 'purchase'")):
        _files(part.select("line"), spark, sf, "text", src)
    return src


def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Broken lines and bodies go to the quarantine, resent messages are
    taken once, over several micro-batches."""
    from ..streaming import deliveries as D
    src, root = _resent(spark, sf), scratch_path(spark, "s1-log")
    D.ingest_log_stream(spark, src, root, scratch_path(spark, "s1-log-ckpt"), max_files_per_trigger=_per_trigger(spark, src), clean=clean_body).awaitTermination()
    good = D.read_messages_log(spark, root).select("msg_id", F.lit("message").alias("kind"), F.md5("cleaned").alias("content_md5"))
    bad = D.read_quarantine(spark, root)
    return good.unionByName(bad.select("msg_id", F.col("reason").alias("kind"), F.lit(None).cast("string").alias("content_md5")))


def stream_cost_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Windows by provider and by model, and the rows behind the watermark;
    the log comes in four parts, of which the third is older than allowed.  The
    stream stops after each part and goes on from its checkpoint."""
    from ..streaming import deliveries as D
    src, root, ck = scratch_path(spark, "s2-levels"), scratch_path(spark, "s2-log"), scratch_path(spark, "s2-log-ckpt")
    week = F.floor(F.dayofmonth(F.to_date(F.substring("timestamp", 1, 10))) / 8)
    for k in (1, 2, 0, 3):   # the first days come third
        T.cost_log(spark, sf).where(week == k).drop("ord").write.mode("append").json(src)
        D.cost_levels_stream(spark, src, root, ck, delay_hours=48).awaitTermination()
    w = D.read_cost_levels(spark, root).select(_ts("window_start").alias("window_start"), "level", "key", "runs", "tokens", _r(F.col("cost")).alias("cost"))
    late = D.read_late(spark, root).groupBy(F.col("reason").alias("key")).agg(F.count(F.lit(1)).alias("runs"), F.sum("total_tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return w.unionByName(late.select(F.lit(None).cast("string").alias("window_start"), F.lit("late").alias("level"), "key", "runs", "tokens", _r(F.col("cost")).alias("cost")))


QUERIES = {
    "issues_per_source": issues_per_source,
    "issues_ties": issues_ties,
    "source_totals": source_totals,
    "date_extent": date_extent,
    "rfc2822_dates": rfc2822_dates,
    "latest_24h": latest_24h,
    "breaking_flag": breaking_flag,
    "sender_parse": sender_parse,
    "select_messages": select_messages_q,
    "select_by_address": select_by_address,
    "message_parse": message_parse,
    "clean_html": clean_html,
    "clean_markup": clean_markup,
    "strip_css": css_strip,
    "cost_rollup": cost_rollup,
    "cost_shares": cost_shares,
    "cost_lookback": cost_lookback_q,
    "cost_log_appends": cost_log_appends,
    "json_records": json_records,
    "body_urls": body_urls,
    "homepage_pick": homepage_pick,
    "homepage_resolve": homepage_resolve,
    "registry_merge": registry_merge,
    "source_lines": source_lines,
    "registry_quality": registry_quality,
    "quality_rollup": quality_rollup,
    "quality_report": quality_report,
    "review_queue": review_queue,
    "review_apply": review_apply,
    "review_summary": review_summary,
    "prompt_blocks": prompt_blocks,
    "prompt_pack": prompt_pack,
    "prompt_budget": prompt_budget,
    "topic_titles": topic_titles_q,
    "route_models": route_models,
    "usage_rows": usage_rows,
    "response_topics": response_topics,
    "score_stub": score_stub,
    "report_topics": report_topics,
    "report_sections": report_sections,
    "report_no_latest": report_no_latest,
    "stream_ingest": stream_ingest,
    "stream_cost": stream_cost,
    "stream_registry": stream_registry,
    "stream_quarantine": stream_quarantine,
    "stream_cost_levels": stream_cost_levels,
}
