"""Batch review of unverified registry entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .select import unverified


def review_queue(registry: DataFrame) -> DataFrame:
    """(name, url) of every unverified entry."""
    return unverified(registry).select("name", "url")


def one_decision(decisions: DataFrame) -> DataFrame:
    """(name, act, new_url): one decision per name; of several the greatest by
    action and then URL counts, so a registry row never multiplies."""
    d = decisions.select("name", F.lower(py_strip(F.col("action"))).alias("act"), "new_url")
    return d.groupBy("name").agg(F.max(F.struct("act", "new_url")).alias("d")).select("name", "d.act", "d.new_url")


def apply_decisions(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """A → verified; e → new URL (stripped) + verified; d → removed;
    s / anything else → unchanged.  Verified entries are never touched.
    Output: name, url, verified, changed."""
    d = one_decision(decisions)
    j = registry.join(d, "name", "left")
    open_ = ~F.coalesce(F.col("verified"), F.lit(False))
    act = F.when(open_, F.col("act"))
    return j.where(F.coalesce(act != "d", F.lit(True))).select(
        "name",
        F.when(act == "e", py_strip(F.col("new_url"))).otherwise(F.col("url")).alias("url"),
        F.when(act.isin("a", "e"), F.lit(True)).otherwise(F.col("verified")).alias("verified"),
        F.coalesce(act.isin("a", "e"), F.lit(False)).alias("changed"),
    )


def review_summary(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """How many entries change (accepted, edited, deleted); the caller
    writes a new registry version only when this is > 0."""
    d = one_decision(decisions)
    j = unverified(registry).join(d, "name")
    return j.agg(
        F.count_if(F.col("act") == "a").alias("n_accepted"),
        F.count_if(F.col("act") == "e").alias("n_edited"),
        F.count_if(F.col("act") == "d").alias("n_deleted"),
    ).withColumn("changed", (F.col("n_accepted") + F.col("n_edited") + F.col("n_deleted")) > 0)
