"""Connected components of a table of links, as Spark joins.

Alternating large-star and small-star rounds turn any set of links into
stars around each component's smallest node.  A hub is never gathered: a
round needs only each node's smallest neighbour (an aggregate that combines
map-side) and a join of the links with it, both sides read from written
tables so that AQE may split a hub's partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one partition → the same components with one link per node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, root(x)) for x in parent]
    step = 100_000
    for i in range(0, len(out), step):
        yield pd.DataFrame(out[i:i + step], columns=["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select("a", F.least("a", "m").alias("m")), "least")
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
                 .unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) longs → (node, label): every linked node but the smallest of its
    component, and that smallest one.  Self-links and repeated links are allowed; nodes without
    a link to another are absent; no links give no rows.  Rows with a null
    end are no links."""
    spark = links.sparkSession
    prepare(spark)
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    links = stored(links.mapInPandas(_forest, "a long, b long"), "links")
    seen = None
    while True:
        links = stored(_star(_star(links, True), False), "links")
        # small star leaves (node, least); when a round changes nothing, done
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or now["n"] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = now
