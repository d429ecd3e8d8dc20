"""Mixing sources to target weights by entropy balancing.

Of all document rates r that give each source its target number of words, the
one nearest to taking every document once (least relative entropy, no rate
above ``MOST``) is r = min(MOST, exp(dual * x)), x a document's size over its
source's mean size: one multiplier a source, the solution of a convex dual.
Newton's method on the dual runs for all sources at once; a step is one
aggregation over the counts of documents by source and size, kept within
bounds of the solution.  Rates become whole copies by cumulative rounding over
documents in the order of their size, so a source's words stay near its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import aside, prepare, stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of a source that are rounded together.
BLOCK = 2_000
#: Newton steps stop when every source is within this share of its target.
CLOSE, STEPS = 1e-9, 100
#: Documents a source whose copies are corrected after rounding, at most.
SETTLE = 3


def words(text: str | Column) -> Column:
    """Number of words: runs of other than the six ASCII blanks."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) → also target: shares of all sizes by weight, none
    above ``most`` times its source's size, the excess reshared by weight.

    One row a source, already summed: the order of the sources (by code point,
    null last) and the running sums need them in one place."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * float(most)
    x = sources.select("source", "source_size", w.alias("w")).withColumn("full", full)
    # in the order of full / w sources fill up first; those before the first that doesn't are full
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after)
    x = x.withColumn("level", level).withColumn("is_full", F.col("level") * F.col("w") >= F.col("full"))
    free = F.min(F.when(~F.col("is_full"), F.struct(F.col("full") / F.col("w"), "level"))).over(every)["level"]
    return x.select("source", "source_size", F.when(F.col("is_full"), F.col("full")).otherwise(free * F.col("w")).alias("target"))


def _rate(dual: Column, x: Column, most: int) -> Column:
    return F.when(dual * x >= math.log(most), F.lit(float(most))).otherwise(F.exp(F.least(dual * x, F.lit(math.log(most)))))


def duals(counts: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n) and (source, source_size, mean, least, target) → the
    sources with their dual: Newton steps on the logarithm of the words, a
    bisection where a step would leave the bounds.

    Sums are of decimals, so that the order of rows doesn't change them."""
    ratio = F.try_divide(F.col("target"), F.col("source_size"))
    top = F.try_divide(F.lit(math.log(most)), F.col("least"))
    state = stored(sources.withColumns({
        "full": (F.col("source_size") == 0) | (ratio >= most), "dual": F.lit(0.0),
        "lo": F.when(ratio < 1, F.try_divide(F.log(ratio), F.col("least"))).otherwise(F.lit(0.0)),
        "hi": F.when(ratio < 1, F.lit(0.0)).otherwise(top), "off": F.lit(1.0)}), "duals")
    exact = "decimal(38,9)"
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("dual"), x, most)
        grown = F.when(r < most, F.col("n") * F.col("size") * x * r).otherwise(F.lit(0.0))
        sums = counts.join(state.where("not full and off > 0").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))) \
            .groupBy("source").agg(F.sum((F.col("n") * F.col("size") * r).cast(exact)).cast("double").alias("f"),
                                   F.sum(grown.cast(exact)).cast("double").alias("g")).withColumnRenamed("source", "_s")
        known = F.col("f").isNotNull()
        off = F.abs(F.try_divide(F.col("f"), F.col("target")) - 1)
        high = F.col("f") > F.col("target")
        lo, hi = F.when(high, F.col("lo")).otherwise(F.col("dual")), F.when(high, F.col("dual")).otherwise(F.col("hi"))
        step = F.col("dual") - (F.log("f") - F.log("target")) * F.try_divide(F.col("f"), F.col("g"))
        next_dual = F.when((F.col("g") > 0) & (step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        more = known & (off > CLOSE)
        state = stored(state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "mean", "least", "target", "full",
            F.when(more, next_dual).otherwise(F.col("dual")).alias("dual"),
            F.when(more, lo).otherwise(F.col("lo")).alias("lo"), F.when(more, hi).otherwise(F.col("hi")).alias("hi"),
            F.when(more, off).otherwise(F.lit(0.0)).alias("off")), "duals")
        if state.where("not full and off > 0").isEmpty():
            break
    return state


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate,
    copies, taken (= copies * size).

    Null texts and texts without a word have size 0 and are taken once, in
    sources at their limit ``most`` times; the null source is a source, the last
    one; null ids and repeated rows are documents like others; rows with equal
    source, size and id are alike, so which of them gets a copy more is open; an
    empty table, or one without a word, mixes no words; other columns are not
    read."""
    spark = docs.sparkSession
    prepare(spark)
    rows = stored(docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), words(docs[text]).alias("size")), "sizes")
    counts = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"),
                                           F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    shares = targets(sources.select("source", "source_size"), weights, most).withColumnRenamed("source", "_s")
    sized = stored(sources.join(shares.drop("source_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
                   .withColumn("mean", F.col("source_size") / F.col("n")), "sources")
    solved = duals(counts.where("size > 0"), sized.select(
        "source", "source_size", "mean", F.try_divide(F.col("least").cast("double"), F.col("mean")).alias("least"), "target"), most)
    known = stored(solved.join(sized.select(F.col("source").alias("_s"), F.ceil(F.col("n") / BLOCK).alias("blocks")),
                               F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_s"), "known")
    rate = F.when(F.col("full") & (F.col("source_size") > 0), F.lit(float(most))) \
            .when(F.col("full") | (F.col("size") == 0), F.lit(1.0)) \
            .otherwise(_rate(F.round("dual", 9), F.try_divide(F.col("size").cast("double"), F.col("mean")), most))
    met = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", F.round(rate, 9).cast("decimal(20,9)").alias("rate"),
        F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"))
    upto = Window.partitionBy("source", "block").orderBy(F.col("size").desc(), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = F.lit("0.5").cast("decimal(2,1)")
    summed = met.withColumn("upto", F.sum("rate").over(upto))
    copies = (F.floor(F.col("upto") + half) - F.floor(F.col("upto") - F.col("rate") + half)).cast("long")
    rounded = stored(summed.select("doc_id", "source", "size", "source_size", "target", F.col("rate").cast("double").alias("rate"),
                                   copies.alias("copies"), "block"), "rounded")
    return _settled(rounded, most).withColumn("taken", F.col("copies") * F.col("size"))


def _settled(rounded: DataFrame, most: int) -> DataFrame:
    """Rounded copies with up to ``SETTLE`` documents a source changed by one
    copy, each time the one whose size is nearest to the words still missing
    (or too many).  They are of the source's block 0, whose size is bounded."""
    rest = rounded.where("block != 0")
    taken = rest.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("other")).withColumnRenamed("source", "_s")
    first = stored(rounded.where("block = 0").join(taken, F.col("source").eqNullSafe(F.col("_s")), "left")
                   .drop("_s").withColumn("other", F.coalesce("other", F.lit(0))), "first")
    whole = Window.partitionBy("source")
    for _ in range(SETTLE):
        missing = F.col("target") - F.col("other") - F.sum(F.col("copies") * F.col("size")).over(whole)
        x = first.withColumn("_m", missing)
        way = F.signum("_m").cast("long")
        left = F.abs(F.abs("_m") - F.col("size"))
        open_ = (F.col("copies") + way).between(0, most) & (left < F.abs("_m")) & (F.col("size") > 0)
        best = F.row_number().over(whole.orderBy(F.when(open_, left).asc_nulls_last(), "size", "doc_id"))
        first = stored(x.withColumn("copies", F.when((best == 1) & open_, F.col("copies") + way).otherwise(F.col("copies"))).drop("_m"), "first")
    return rest.unionByName(first.drop("other")).drop("block")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, a row for each copy, with the
    columns of ``docs``.  Rows that repeat an id share the copies of them all
    evenly, the first by their text's hash taking what is left over."""
    docs, back = aside(docs)
    found = stored(mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")), "copies")
    # a shuffle join at any size: what is joined grows with the documents
    met = docs.join(found.hint("merge"), docs["doc_id"].eqNullSafe(found["_id"]))
    if not found.where("_rows > 1").isEmpty():
        k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *docs.columns))
        met = met.withColumn("_k", k).withColumn("_copies", F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_k") <= F.col("_copies") % F.col("_rows")).cast("long"))
    return back(met.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))))
