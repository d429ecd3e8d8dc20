"""One topic list per report (E2, E3): replies are merged in rounds.

The original packs all records into one prompt and gets one list of topics.
Here a prompt is bounded, so a report has many replies.  Each round packs the
replies of ``fan_in`` neighbouring batches into one prompt that asks for the
topics that matter most of all of them, until one reply a report is left:
log(batches) rounds, each prompt no longer than ``fan_in`` replies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.responses import keep_topics
from ..session import stored
from .prompts import response_content

MERGE_HEAD = """
You receive topic lists from several analyses, separated by headers; each analysis read a part of one set of messages. Put topics on the same subject matter together and report the {n} groups that matter most.
Start each group with a heading of the form "### <number>. <title>" on its own line, then one paragraph of summary and a line that names the senders.

ANALYSES:
"""


def merge_prompts(replies: DataFrame, num_topics: int, fan_in: int = cfg.MERGE_FAN_IN, template: str = MERGE_HEAD) -> DataFrame:
    """Replies (report_id, batch_id, text) → (report_id, batch_id, n, text,
    prompt), one row for each ``fan_in`` neighbouring batches; a group of one
    reply has it as ``text``, others have a prompt."""
    number = (F.col("batch_id") % fan_in + 1).cast("string")
    block = F.concat(F.lit("ANALYSIS #"), number, F.lit("\n"), F.col("text"), F.lit("\n"))
    g = replies.select("report_id", "text", block.alias("block"), "batch_id", F.floor(F.col("batch_id") / fan_in).cast("long").alias("up")) \
        .groupBy("report_id", F.col("up").alias("batch_id")).agg(
            F.count(F.lit(1)).alias("n"), F.expr("listagg(block, '\\n') WITHIN GROUP (ORDER BY batch_id)").alias("blocks"), F.first("text").alias("text"))
    many = F.col("n") > 1
    return g.select("report_id", "batch_id", "n", F.when(~many, F.col("text")).alias("text"),
                    F.when(many, F.concat(F.lit(template.format(n=num_topics)), F.col("blocks"))).alias("prompt"))


def one_reply(replies: DataFrame, score: Callable[[DataFrame], DataFrame], num_topics: int = cfg.DEFAULT_NUM_TOPICS,
              fan_in: int = cfg.MERGE_FAN_IN) -> tuple[DataFrame, list[DataFrame]]:
    """Replies (report_id, batch_id from 0, text) → (report_id, text): one
    reply with ``num_topics`` topics a report (fewer if its replies have fewer
    different ones), numbered from 1; and the scored merges of every round.

    ``score`` takes (report_id, batch_id, prompt) and gives back these without
    ``prompt`` and with ``response``, as ``scoring.score_once`` does.  A merge
    that fails is replaced by the first topics of its replies; a NULL text (a
    reply that failed) has none."""
    if fan_in < 2:
        raise ValueError("a round merges two replies at least")
    level, calls = stored(replies.select("report_id", "batch_id", F.coalesce("text", F.lit("")).alias("text")), "replies"), []
    while (level.agg(F.max("batch_id")).first()[0] or 0) > 0:
        groups = stored(merge_prompts(level, num_topics, fan_in), "merges")
        scored = stored(score(groups.where("prompt is not null").select("report_id", "batch_id", "prompt")), "merged")
        calls.append(scored)
        answers = response_content(scored).select("report_id", "batch_id", F.col("text").alias("answer"))
        text = F.coalesce("text", F.nullif(F.col("answer"), F.lit("")), keep_topics(F.col("prompt"), num_topics))
        level = stored(groups.join(answers, ["report_id", "batch_id"], "left").select("report_id", "batch_id", text.alias("text")), "replies")
    return level.select("report_id", keep_topics(F.col("text"), num_topics).alias("text")), calls
