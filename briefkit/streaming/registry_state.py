"""S3: the registry from a stream, as deltas by key.

What the batch operators know of all messages is carried from one micro-batch
to the next: per sender the number of issues, the place of the first one and
its homepage.  Several senders may have one registry key, of which the last in
rank order wins; rank is compared among the senders of that key only, so a
micro-batch reads and writes the keys it touches and no others.

Each micro-batch is one commit (``sources.commitlog``) with two tables: the
senders touched, with their totals so far, and the entries of their keys (one
marked ``gone`` where an earlier first record turned up that has no homepage).
The newest row of a sender or key counts, before the registry that the stream
started with; every ``compact_every`` commits the newest rows are written as one.  Tables are partitioned by a hash of the key, so a
small batch opens few files.  A replayed micro-batch finds its commit and does
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import registry_key, sender_name
from ..functions.urls import homepage_from_body
from ..operators import sites
from ..operators.stats import keyed
from ..session import stored
from ..sources import commitlog

PARTS = 32
COMPACT_EVERY = 20
SOURCES = "key string, sender string, issues long, o long, t long, home string, part int"
ENTRIES = "name string, url string, verified boolean, gone boolean, part int"
INITIAL = "name string, url string, verified boolean, part int"


def _part(key: str) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "_rank")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_rank").alias("_r")).select(*keys, "_r.*")


def _write(spark: SparkSession, root: str, tables: dict[str, DataFrame], **entry) -> None:
    batch = commitlog.new_batch()
    for name, rows in tables.items():
        rows.repartition("part").write.partitionBy("part").parquet(f"{commitlog.batch_path(root, batch)}/{name}")
    commitlog.commit(spark, root, batch, **entry)


def start(spark: SparkSession, root: str, initial: DataFrame | None) -> None:
    """The first commit: an existing registry."""
    if initial is not None and not commitlog.commits(spark, root):
        _write(spark, root, {"initial": initial.select("name", "url", "verified", _part("name"))})


def batch_sources(records: DataFrame) -> DataFrame:
    """Per sender of a micro-batch: issues, the first record's place (o, t) and
    its homepage.  The homepage is picked before the aggregate, which combines
    map-side, so no body is shuffled."""
    x = keyed(records, homepage_from_body(F.col("body")).alias("home")).where("sender is not null")
    per = x.groupBy("sender").agg(F.count(F.lit(1)).alias("issues"), F.min(F.struct("_o", "_t")).alias("f"), F.min_by("home", F.struct("_o", "_t")).alias("home"))
    return per.select(registry_key(sender_name(F.col("sender"))).alias("key"), "sender", "issues", F.col("f._o").alias("o"), F.col("f._t").alias("t"), "home")


def upsert(spark: SparkSession, root: str, records: DataFrame, curated: DataFrame, mark: int, compact_every: int = COMPACT_EVERY) -> None:
    """Apply one micro-batch of message records as commit ``mark``."""
    if commitlog.applied(spark, root, mark):
        return
    new = stored(batch_sources(records).select("*", _part("key")), "s3-batch")
    parts = [r[0] for r in new.select("part").distinct().collect()]   # PARTS at most
    keys = new.select("key").distinct()
    old = commitlog.read(spark, root, SOURCES, "sources").where(F.col("part").isin(parts)).join(keys, "key", "left_semi")
    old = _newest(old, "key", "sender")
    every = stored(old.unionByName(new).groupBy("key", "sender", "part").agg(
        F.sum("issues").alias("issues"), F.min(F.struct("o", "t")).alias("f"), F.min_by("home", F.struct("o", "t")).alias("home"))
        .select("key", "sender", "issues", F.col("f.o").alias("o"), F.col("f.t").alias("t"), "home", "part"), "s3-sources")

    registry = commitlog.read(spark, root, INITIAL, "initial").where(F.col("part").isin(parts)).select("name", "url", "verified")
    # rank order within a key: issues first, then the earlier first record
    ranked = every.select("sender", "issues", F.struct((-F.col("issues")).alias("i"), "o", "t", "sender").alias("rank"), F.struct(F.col("home").alias("body")).alias("first"))
    merged = sites.merge_registry(None, sites.resolve_homepages(ranked, registry, curated))
    entries = keys.withColumnRenamed("key", "name").join(merged, "name", "left").select("name", "url", "verified", F.col("url").isNull().alias("gone"), _part("name"))
    _write(spark, root, {"sources": every.join(new.select("sender"), "sender", "left_semi"), "entries": entries}, mark=mark)
    if len(commitlog.commits(spark, root)) > compact_every:
        compact(spark, root)


def compact(spark: SparkSession, root: str) -> None:
    """Write the newest rows of all commits so far as one."""
    live = commitlog.commits(spark, root)
    if live:
        marks = [c.mark for c in live if c.mark is not None]
        tables = {"sources": _newest(commitlog.read(spark, root, SOURCES, "sources"), "key", "sender"),
                  "entries": _newest(commitlog.read(spark, root, ENTRIES, "entries"), "name"),
                  "initial": commitlog.read(spark, root, INITIAL, "initial").drop("_rank")}
        _write(spark, root, tables, upto=max(c.rank for c in live), mark=max(marks, default=None))


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The registry now: (name, url, verified)."""
    new = _newest(commitlog.read(spark, root, ENTRIES, "entries"), "name").where("not gone").select(
        "name", F.struct("url", "verified").alias("n"))
    old = commitlog.read(spark, root, INITIAL, "initial").select("name", F.struct("url", "verified").alias("o"))
    best = F.coalesce("n", "o")
    return old.join(new, "name", "full_outer").select("name", best["url"].alias("url"), best["verified"].alias("verified"))
