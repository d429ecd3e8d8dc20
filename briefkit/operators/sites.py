"""Homepage resolution and the site registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.text import email_domain, normalize, py_strip, registry_key, sender_email, sender_name
from ..functions.urls import homepage_from_body


def curated_sites(spark: SparkSession) -> DataFrame:
    """The fixed curated list as a dimension (ord, name, url)."""
    rows = [(i, n, u) for i, (n, u) in enumerate(cfg.CURATED_SITES)]
    return spark.createDataFrame(rows, "ord long, name string, url string")


def curated_match(senders: DataFrame, curated: DataFrame, fixed: bool = False) -> DataFrame:
    """H1: per sender, the lowest-ordinal curated entry whose normalised
    name is a substring of the sender's normalised name.

    Any list is matched by an exact equi-join: each sender
    name is cut into its substrings of the lengths the curated keys have,
    and those are joined on equality — a shuffle join that grows with
    both sides and never pairs every sender with every entry.  The ``fixed``
    list of the configuration, a constant, is broadcast and matched with
    ``contains`` instead.
    Input needs ``sender`` and ``norm``; output (sender, curated_url).
    """
    c = curated.select(F.col("ord").alias("c_ord"), normalize(F.col("name")).alias("c_norm"),
                       F.col("url").alias("c_url"))
    s = senders.select("sender", "norm")
    if fixed:
        j = s.join(F.broadcast(c), F.col("norm").contains(F.col("c_norm")))
    else:
        lengths = sorted(r[0] for r in c.select(F.length("c_norm")).distinct().collect())
        n = F.length("norm")
        subs = s.select("sender", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("L"), "norm")
        subs = subs.select("sender", F.explode(
            F.when(n >= F.col("L"), F.sequence(F.lit(1), n - F.col("L") + 1)).otherwise(F.array().cast("array<int>"))
        ).alias("pos"), "L", "norm")
        subs = subs.select("sender", F.substring(F.col("norm"), F.col("pos"), F.col("L")).alias("c_norm")).distinct()
        j = subs.join(c, "c_norm")
    return j.groupBy("sender").agg(F.min_by("c_url", "c_ord").alias("curated_url"))


def resolve_homepages(sources: DataFrame, registry: DataFrame | None, curated: DataFrame, fixed: bool = False) -> DataFrame:
    """H2–H4 on the per-source table (``sender``, ``rank``, ``first.body``).

    Priority: verified registry entry > curated > sender domain > body URL.
    An entry with an empty URL counts as absent.  Each sender resolves
    independently (see README: the original's in-loop cache reads only
    verified entries, which depend on the key alone).
    """
    name = sender_name(F.col("sender"))
    email = sender_email(F.col("sender"))
    s = sources.select(
        "sender", "issues", "rank", F.col("first.body").alias("body"),
        name.alias("name"), email.alias("email"),
        registry_key(name).alias("key"), normalize(name).alias("norm"),
        email_domain(email).alias("domain"),
    )
    cm = curated_match(s, curated, fixed)
    s = s.join(cm, "sender", "left")
    if registry is not None:
        reg = (registry.where(F.coalesce(F.col("verified"), F.lit(False)) & (F.length(F.col("url")) > 0))
               .select(F.col("name").alias("key"), F.col("url").alias("reg_url")))
        s = s.join(reg, "key", "left")
    else:
        s = s.withColumn("reg_url", F.lit(None).cast("string"))
    domain_url = F.when((F.length("norm") > 3) & F.col("domain").contains(F.col("norm")) & (F.length("email") > 0),
                        F.concat(F.lit("https://"), F.col("domain")))
    body_url = homepage_from_body(F.col("body"))
    url = F.coalesce(F.col("reg_url"), F.col("curated_url"), domain_url, body_url)
    source = (F.when(F.col("reg_url").isNotNull(), F.lit("registry"))
              .when(F.col("curated_url").isNotNull(), F.lit("curated"))
              .when(domain_url.isNotNull(), F.lit("domain"))
              .when(body_url.isNotNull(), F.lit("body")))
    return s.select("sender", "name", "email", "key", "issues", "rank",
                    url.alias("url"), source.alias("url_source"),
                    (F.col("reg_url").isNotNull() | F.col("curated_url").isNotNull()).alias("verified"))


def source_lines(resolved: DataFrame) -> DataFrame:
    """H6: '- [name](url) - n issues' (or without a link)."""
    nm = py_strip(F.col("name"))
    line = F.when(F.col("url").isNotNull() & (F.length("url") > 0),
                  F.concat(F.lit("- ["), nm, F.lit("]("), F.col("url"), F.lit(") - "), F.col("issues").cast("string"), F.lit(" issues"))) \
            .otherwise(F.concat(F.lit("- "), nm, F.lit(" - "), F.col("issues").cast("string"), F.lit(" issues")))
    return resolved.select("rank", line.alias("line"))


def merge_registry(old: DataFrame | None, resolved: DataFrame) -> DataFrame:
    """H5: write (key, url, verified) for every resolved sender; several
    senders with one key → the last in rank order wins; other keys stay."""
    new = (resolved.where(F.col("url").isNotNull() & (F.length("url") > 0))
           .groupBy(F.col("key").alias("name"))
           .agg(F.max_by(F.struct("url", "verified"), "rank").alias("n")))
    if old is None:
        return new.select("name", "n.url", "n.verified")
    o = old.select("name", F.col("url").alias("o_url"), F.col("verified").alias("o_verified"))
    m = o.join(new, "name", "full_outer")
    return m.select("name",
                    F.when(F.col("n").isNotNull(), F.col("n.url")).otherwise(F.col("o_url")).alias("url"),
                    F.when(F.col("n").isNotNull(), F.col("n.verified")).otherwise(F.col("o_verified")).alias("verified"))
