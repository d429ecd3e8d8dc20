"""End-to-end plans for the original tool's entry points.

* ``run_summary``     — the summary run: select → prompts → scoring →
  titles → report (+ cost rows appended, registry version written).
* ``run_cost_report`` — the cost analysis (A3, B6, F7–F12).
* ``run_validation``  — registry file validation (I1–I13, F13).
* ``run_review``      — batch review of the registry (J1–J3, A6).

They compose the operators and own the I/O; the operators stay pure.
Prompts go through a ledger of answers, so the model is called once per
prompt whatever uses the replies; with ``SummaryParams.ledger`` a run that
failed goes on with the prompts still unanswered.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.markdown import clean_markdown
from ..functions.responses import topic_titles
from ..operators import costs, digest, prompts, quality, review, scoring, sites, stats
from ..operators.select import select_messages
from ..session import scratch_path
from ..session import stored as saved
from ..sources.commitlog import is_log
from ..sources.costlog import append_cost_rows, good_rows, read_cost_log
from ..sources.messages import read_messages
from ..sources.registry import read_registry, registry_entries, write_registry_version
from ..sources.report_sink import write_report
from ..streaming.deliveries import read_messages_log
from . import report as R


@dataclass
class SummaryParams:
    run_ts: dt.datetime
    days: int = cfg.DEFAULT_DAYS
    label: str | None = None
    from_email: str | None = None
    to_email: str | None = None
    num_topics: int = cfg.DEFAULT_NUM_TOPICS
    provider: str = "openai"
    custom_model: str | None = None
    include_latest: bool = True
    front_matter: bool = False
    batch_items: int = cfg.PROMPT_BATCH_ITEMS
    fan_in: int = cfg.MERGE_FAN_IN        # replies merged by one prompt
    system: str | None = None             # system message of every prompt
    max_tokens: int | None = None         # output cap of every prompt
    ledger: str | None = None             # folder of answers kept between runs


def route(spark: SparkSession, provider: str, custom_model: str | None) -> dict:
    """H7 for one run (a 1-row request); unknown provider without a custom
    model is an error, as in the original."""
    req = spark.createDataFrame([(provider, custom_model)], "provider string, custom_model string")
    r = prompts.route_models(req, prompts.provider_models(spark)).first().asDict()
    if r["route_status"] != "ok":
        raise ValueError(f"Unknown model provider: {provider}")
    return r


def run_summary(spark: SparkSession, messages_path: str, out_dir: str, p: SummaryParams,
                cost_log_path: str, registry_root: str, registry_path: str | None = None,
                curated: DataFrame | None = None, client_factory=scoring.echo_factory,
                fallback_factory=None, stored: bool = False) -> dict:
    """``messages_path`` holds exported message files, or (``stored``) the
    date-partitioned table or log written by an ingest stream, whose cleaned
    text is reused and whose look-back prunes partitions."""
    if stored:
        msgs = read_messages_log(spark, messages_path) if is_log(spark, messages_path) else spark.read.parquet(messages_path)
        date_col, keep = "received_date", ["cleaned"]
    else:
        msgs = read_messages(spark, messages_path).withColumn("received_ts", F.timestamp_millis("internalDate")) \
                                                  .withColumn("ord", F.col("internalDate"))
        date_col, keep = None, []
    n_quarantined = msgs.where("not decode_ok").count()
    msgs = msgs.where("decode_ok")   # the others are the quarantine: see n_quarantined
    sel = select_messages(msgs, as_of=p.run_ts, days=p.days, label=p.label, from_email=p.from_email,
                          to_email=p.to_email, date_col=date_col)
    recs = sel.select("ord", "msg_id", "subject", "date", "sender", "body", "body_format", *keep)
    if recs.limit(1).count() == 0:                       # B7: nothing to summarise
        return {"n_messages": 0, "n_quarantined": n_quarantined}
    r = route(spark, p.provider, p.custom_model)
    packed = prompts.pack_prompts(prompts.prompt_items(recs, p.batch_items, clean=clean_markdown), p.num_topics)
    score = partial(scoring.score_once, model=r["model"], ledger=p.ledger or scratch_path(spark, "ledger"), client_factory=client_factory,
                    fallback_factory=fallback_factory, fallback_model=r["direct_model"], system=p.system, max_tokens=p.max_tokens)
    first = saved(score(packed.select(F.lit(0).cast("long").alias("report_id"), "batch_id", "prompt")), "replies")
    final, merges = digest.one_reply(prompts.response_content(first).select("report_id", "batch_id", "text"), score, p.num_topics, p.fan_in)
    analysis = saved(final.select(F.col("report_id").alias("batch_id"), "text"), "analysis")
    scored_path = scratch_path(spark, "scored")
    reduce(DataFrame.unionByName, merges, first).write.parquet(scored_path)

    usage = prompts.usage_rows(spark.read.parquet(scored_path).select("batch_id", "response", "model",
                                                                      F.lit(r["log_provider"]).alias("log_provider")), p.run_ts)
    append_cost_rows(usage.withColumnRenamed("log_provider", "provider"), cost_log_path, order="batch_id")
    n_topics = analysis.select(F.explode(topic_titles(F.col("text")))).count()

    registry = read_registry(spark, registry_path or registry_root).drop("ord")
    cur = curated if curated is not None else sites.curated_sites(spark)
    rp = R.ReportParams(run_ts=p.run_ts, days=p.days, model_label=r["model_label"],
                        model_ts=p.run_ts.isoformat(), include_latest=p.include_latest, front_matter=p.front_matter)
    rows = R.build_report(recs, analysis, registry, cur, rp)
    name = R.report_file_name(recs, rp).first().file_name
    report_path = write_report(rows, f"{out_dir.rstrip('/')}/{name}")

    resolved = sites.resolve_homepages(stats.issues_per_source(recs), registry, cur)
    new_registry = write_registry_version(sites.merge_registry(registry, resolved), registry_root)
    return {"n_messages": recs.count(), "n_quarantined": n_quarantined, "n_topics": n_topics, "file_name": name, "report": report_path,
            "registry": new_registry, "scored": scored_path}


def run_cost_report(spark: SparkSession, log_path: str, as_of: dt.datetime,
                    days: int | None = cfg.DEFAULT_COST_DAYS) -> DataFrame:
    """Cost analysis: totals, by provider, by model, with shares."""
    return costs.cost_shares(costs.cost_rollup(good_rows(read_cost_log(spark, log_path)), as_of, days))


def run_validation(spark: SparkSession, registry_file: str) -> tuple[DataFrame, DataFrame]:
    """Validation of a registry file, or of the newest version below a
    registry folder → (roll-up, listing lines)."""
    file_errors, entries = registry_entries(spark, registry_file)
    errs = quality.registry_errors(quality.variant_entries(entries))
    all_msgs = errs.select("ord", "rule_seq", "message").unionByName(
        file_errors.select(F.lit(-1).cast("long").alias("ord"), F.lit(0).alias("rule_seq"), "message"))
    return quality.validation_rollup(all_msgs), quality.validation_listing(all_msgs)


def run_review(spark: SparkSession, registry_file: str, decisions: DataFrame, registry_root: str) -> dict:
    """Apply decisions; write a new registry version only when something changed."""
    reg = read_registry(spark, registry_file).drop("ord")
    summary = review.review_summary(reg, decisions).first()
    if not summary["changed"]:
        return {"changed": False}
    path = write_registry_version(review.apply_decisions(reg, decisions).drop("changed"), registry_root)
    return {"changed": True, "registry": path, **summary.asDict()}
