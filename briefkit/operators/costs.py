"""Model-call cost roll-up (F7–F12) — one GROUPING SETS aggregate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..session import stored
from .select import cost_lookback


def cost_rollup(log: DataFrame, as_of: dt.datetime, days: int | None = cfg.DEFAULT_COST_DAYS) -> DataFrame:
    """Totals, by provider and by model in one pass.

    Missing provider/model → 'unknown'; missing or null cost/tokens → 0.
    ``first_ord`` (first appearance in the log) is the group order (F12).
    Output: level, key, runs, tokens, cost, first_ord.
    """
    x = cost_lookback(log, as_of, days).select(
        F.coalesce("provider", F.lit(cfg.UNKNOWN_KEY)).alias("provider"),
        F.coalesce("model", F.lit(cfg.UNKNOWN_KEY)).alias("model"),
        F.coalesce("total_tokens", F.lit(0)).alias("tokens"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        "ord",
    )
    g = x.groupingSets([[], ["provider"], ["model"]], "provider", "model").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("runs"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.min("ord").alias("first_ord"),
    )
    level = F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "provider").otherwise("model")
    key = F.when(F.col("gid") == 1, F.col("provider")).when(F.col("gid") == 2, F.col("model"))
    return g.select(level.alias("level"), key.alias("key"), "runs", "tokens", "cost", "first_ord")


def cost_shares(rollup: DataFrame) -> DataFrame:
    """shares of the total and cost per 1k tokens.

    The roll-up, a row a group, is written once, so the log is read once; the
    totals come from its total row as a scalar subquery (no join).  Run and token shares exist for providers
    only; a zero denominator gives 0 for the cost share (as the original)
    and NULL elsewhere.
    """
    rollup = stored(rollup, "rollup")
    tot = rollup.where(F.col("level") == "total").select(
        F.struct(F.max("cost").alias("cost"), F.max("runs").alias("runs"), F.max("tokens").alias("tokens")))
    t = tot.scalar()  # one scalar subquery for all three totals
    t_cost, t_runs, t_tokens = t["cost"], t["runs"], t["tokens"]
    prov = F.col("level") == "provider"
    return rollup.select(
        "level", "key", "runs", "tokens", "cost", "first_ord",
        F.when(F.col("level") == "total", F.when(F.col("runs") > 0, F.col("cost") / F.col("runs")).otherwise(F.lit(0.0)))
         .alias("avg_cost_per_run"),
        F.when(F.col("level") != "total",
               F.when(t_cost != 0, F.col("cost") / t_cost * 100).otherwise(F.lit(0.0))).alias("pct_cost"),
        F.when(prov, F.try_divide(F.col("runs").cast("double"), t_runs) * 100).alias("pct_runs"),
        F.when(prov, F.try_divide(F.col("tokens").cast("double"), t_tokens) * 100).alias("pct_tokens"),
        F.when((F.col("level") != "total") & (F.col("tokens") != 0),
               F.col("cost") / F.col("tokens") * 1000).alias("cost_per_1k"),
    )
