"""Global numbering in a total order without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row
into one task.  Here the rows are cut into ``n`` key ranges whose bounds
are approximate quantiles of a numeric range key (one narrow aggregate;
the ``n - 1`` bounds are the only thing brought to the driver, exactly
what Spark's own range partitioner does).  Each row's range is a pure
function of its key — a balanced comparison tree over literal bounds, so
every branch of the plan assigns the same range whatever the input order.
Rows are numbered inside their range by a window partitioned on the range,
and shifted by the row counts of the lower ranges (a table of at most
``n`` rows, broadcast with that bound).

The range key must be monotone in the requested order.  With several
numeric ``lead`` keys it is ``k1 * 2 * span(k2) + k2`` in double precision.
Between two values of the first key there is a gap as wide as the second's
span, so rounding cannot swap them whatever the spans are, and ties of the
first key (a value shared by a third of the rows) are still spread over many
ranges by the second.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a range, and of a task of several ranges, that carry a text each:
#: what a task sorts stays in its memory whatever the corpus.
RANGE_ROWS, TASK_ROWS = 5_000, 20_000


def _num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bucket(k: Column, bounds: list[float], lo: int = 0) -> Column:
    """Index of the range holding ``k``: number of bounds <= k (log2 depth)."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    return F.when(k < F.lit(bounds[mid]), _bucket(k, bounds[:mid], lo)) \
            .otherwise(_bucket(k, bounds[mid + 1:], lo + mid + 1))


def range_bounds(df: DataFrame, key: Column, n: int) -> list[float]:
    """``n - 1`` approximate quantiles of ``key`` (distinct, sorted), each
    within a twentieth of a range."""
    if n <= 1:
        return []
    probs = [i / n for i in range(1, n)]
    row = df.select(F.percentile_approx(key, probs, max(10_000, 20 * n))).first()
    vals = row[0] if row is not None and row[0] is not None else []
    return sorted({float(v) for v in vals if v is not None})


def _range_key(df: DataFrame, lead: list[tuple[str, bool]]) -> Column:
    keys = [(F.col(c) if asc else -F.col(c)).cast("double") for c, asc in lead]
    if len(keys) == 1:
        return keys[0]
    # ranges of every key (one narrow aggregate), then a mixed-radix value
    st = df.select(*[F.struct(F.min(k).alias("lo"), F.max(k).alias("hi")) for k in keys]).first()
    if st is None or any(x["lo"] is None for x in st):
        return keys[0]
    key = keys[0] - F.lit(st[0]["lo"])
    for k, x in zip(keys[1:], st[1:]):
        key = key * F.lit(2.0 * (x["hi"] - x["lo"] + 1.0)) + (k - F.lit(x["lo"]))
    return key


def global_rank(df: DataFrame, order: list[Column | str], rank_col: str = "rank",
                lead: list[tuple[str, bool]] | tuple[str, bool] | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 1..N following ``order`` (a total order: end it
    with a unique column).

    ``lead`` = [(column, ascending), ...] are the numeric keys the ranges
    are cut on, in the same order as ``order`` starts; by default the
    leading string items of ``order`` (ascending).
    """
    if lead is None:
        lead = []
        for o in order:
            if not isinstance(o, str):
                break
            lead.append((o, True))
        if not lead:
            raise ValueError("pass lead=[(column, ascending)] when the first order item is a Column")
    elif isinstance(lead, tuple):
        lead = [lead]
    n = num_partitions or _num_partitions(df)
    key = _range_key(df, list(lead))
    bounds = range_bounds(df, key, n)
    x = df.withColumn("_rng", _bucket(key, bounds))
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    local = F.row_number().over(Window.partitionBy("_rng").orderBy(*sort))
    counts = x.groupBy("_rng").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_rng", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    out = x.withColumn("_loc", local).join(F.broadcast(offsets), "_rng")
    return out.withColumn(rank_col, F.col("_off") + F.col("_loc")).drop("_rng", "_loc", "_off")


def global_running_sum(df: DataFrame, order: list[Column | str], value_col: str, out_col: str,
                       lead: list[tuple[str, bool]] | tuple[str, bool] | None = None,
                       num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` over all rows up to and
    including this one in ``order`` — the same key ranges as
    ``global_rank``: a running sum inside each range plus the totals of the
    lower ranges (an ``n``-row table)."""
    if lead is None:
        lead = [(o, True) for o in order if isinstance(o, str)][:1]
    elif isinstance(lead, tuple):
        lead = [lead]
    n = num_partitions or _num_partitions(df)
    key = _range_key(df, list(lead))
    x = df.withColumn("_rng", _bucket(key, range_bounds(df, key, n)))
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    local = F.sum(value_col).over(Window.partitionBy("_rng").orderBy(*sort)
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = x.groupBy("_rng").agg(F.sum(value_col).alias("_t"))
    below = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rng", F.coalesce(F.sum("_t").over(below), F.lit(0)).alias("_off"))
    out = x.withColumn("_loc", local).join(F.broadcast(offsets), "_rng")
    return out.withColumn(out_col, F.col("_off") + F.col("_loc")).drop("_rng", "_loc", "_off")


def _place(o: Column, kind: str, tie: Column) -> Column:
    """Sorts like (``o`` with NULL last, ``tie``)."""
    return F.struct(o.isNull().alias("n"), F.coalesce(o, F.lit(0).cast(kind)).alias("o"), tie.alias("h"))


def _steps(edges: list, kind: str, place: Column) -> Column:
    """Number of ``edges`` (sorted places) below ``place``: a binary search over
    one literal, whatever their number."""
    if not edges:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(edges, default=str)), f"array<struct<n:boolean,o:{kind},h:bigint>>")

    def further(found: Column, half: Column) -> Column:
        return F.when(F.get(table, found + half - 1) < place, found + half).otherwise(found)
    halves = [F.lit(1 << i) for i in range(len(edges).bit_length() - 1, -1, -1)]
    return F.coalesce(F.aggregate(F.array(*halves), F.lit(0), further), F.lit(0))


def in_ranges(df: DataFrame, narrow: DataFrame, ord_col: str, tie: Column, size: int = 1) -> DataFrame:
    """Deal rows to tasks by ranges of their place: ``df`` with ``_rng``, by
    which it is partitioned, and ``_off``, the number of rows in lower ranges.

    The ranges are cut where the number of rows below is a multiple of
    ``size``, so that no batch of ``size`` rows lies in two of them; only rows
    that are alike in ``ord_col`` and ``tie`` stay in one range for that.  The
    cuts come from ``narrow``, the same rows without their wide columns, which
    is stored; a place and a number a range reach the driver.  The rows of
    ``df`` are shuffled once."""
    kind, o = df.schema[ord_col].dataType.simpleString(), F.col(ord_col)
    keys = stored(narrow.select(ord_col, tie.alias("_h")), "places")
    n, rows = _num_partitions(df), keys.count()
    per = max(size, min(RANGE_ROWS, math.ceil(rows / n)))
    ranked = global_rank(keys, [o.asc_nulls_last(), F.col("_h")], "_seq", lead=[(ord_col, True), ("_h", True)]) \
        .select("_seq", _place(o, kind, F.col("_h")).alias("_k"))
    last = ranked.where(F.col("_seq") % size == 0).select(F.col("_seq").alias("_e"), F.col("_k").alias("_a"))
    first = ranked.where((F.col("_seq") - 1) % size == 0).select((F.col("_seq") - 1).alias("_e"), F.col("_k").alias("_b"))
    cuts = last.join(first, "_e").where(F.col("_a") < F.col("_b"))
    kept = cuts.groupBy(F.floor(F.col("_e") / per)).agg(F.min("_e").alias("e"), F.min_by("_a", "_e").alias("a")).collect() if rows > per else []
    kept.sort(key=lambda r: r.e)
    below = F.from_json(F.lit(json.dumps([0, *(r.e for r in kept)])), "array<bigint>")
    tasks = max(math.ceil(rows / TASK_ROWS), min(n, len(kept) + 1))
    x = df.withColumn("_rng", _steps([r.a.asDict() for r in kept], kind, _place(o, kind, tie))).repartition(tasks, "_rng")
    return x.withColumn("_off", F.coalesce(F.get(below, F.col("_rng")), F.lit(0)))


def global_batches(df: DataFrame, order: list[Column], keys: list[str], value_col: str, size: int) -> DataFrame:
    """Add ``batch_id``, the window of ``size`` in which the row's part of the
    running sum of ``value_col`` starts, and ``item_no``, its place from 1 among
    the rows of its batch.

    ``df`` is partitioned by its ranges ``_rng`` (``in_ranges``); everything is
    numbered inside them.  A range's sum below it, the batch it starts in and
    how many rows of that batch lie below are tables of a row a range, from
    ``keys`` (the columns of ``order``) and ``value_col``, which read what
    ``df``'s shuffle wrote."""
    x = df.drop("_off")
    below = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = x.select("_rng", value_col, *keys).withColumn("_start", F.sum(value_col).over(inside) - F.col(value_col))
    totals = sums.groupBy("_rng").agg(F.max(F.col("_start") + F.col(value_col)).alias("_t"))
    offsets = totals.select("_rng", F.coalesce(F.sum("_t").over(below), F.lit(0)).alias("_off"))

    def batched(rows: DataFrame) -> DataFrame:
        start = rows.join(F.broadcast(offsets), "_rng")
        return start.withColumn("batch_id", F.floor((F.col("_off") + F.col("_start")) / size).cast("long")).drop("_off", "_start")

    first = offsets.select(F.col("_rng").alias("_r"), F.floor(F.col("_off") / size).cast("long").alias("_first"))
    shared = batched(sums).join(F.broadcast(first.select(F.col("_first").alias("batch_id")).distinct()), "batch_id", "left_semi") \
        .groupBy("_rng", "batch_id").agg(F.count(F.lit(1)).alias("_n"))
    before = first.join(shared, (F.col("_first") == F.col("batch_id")) & (F.col("_rng") < F.col("_r")), "left") \
        .groupBy("_r", "_first").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_rng", "batch_id").orderBy(*order))
    whole = batched(x.withColumn("_start", F.sum(value_col).over(inside) - F.col(value_col)))
    out = whole.withColumn("_place", place).join(F.broadcast(before), F.col("_rng") == F.col("_r"))
    more = F.when(F.col("batch_id") == F.col("_first"), F.col("_before")).otherwise(F.lit(0))
    return out.withColumn("item_no", (F.col("_place") + more).cast("long")).drop("_r", "_first", "_before", "_place")
