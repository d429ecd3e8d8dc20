"""Registry data-quality rules.

Rules are per-row Column expressions; the only cross-row rule (duplicate
URL, I10) is an aggregate joined back on the URL, so a URL shared by a
third of the rows is handled by partial aggregation and AQE's skew-join
split rather than one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.text import json_repr, py_repr, py_strip
from ..functions.urls import is_generic_url, is_tracking_url, is_valid_url
from ..session import stored
from .sequence import global_rank

RULES = ["I1", "I2", "I3", "I4", "I5", "I6", "I7", "I8", "I9", "I10", "I11"]


def typed_entries(rows: DataFrame) -> DataFrame:
    """Typed registry rows (ord, name, url, verified) → rule inputs.
    A NULL url or verified is a present JSON null."""
    return rows.select(
        "ord", "name",
        F.lit(True).alias("is_object"), F.lit(True).alias("has_url"), F.lit(True).alias("has_verified"),
        F.col("url").isNotNull().alias("url_is_string"), "url",
        F.when(F.col("url").isNull(), F.lit("None")).otherwise(py_repr(F.col("url"))).alias("url_repr"),
        F.col("verified").isNotNull().alias("verified_is_bool"),
        F.when(F.col("verified").isNull(), F.lit("None"))
         .when(F.col("verified"), F.lit("True")).otherwise(F.lit("False")).alias("verified_repr"),
    )


def _variant_repr(v: Column) -> Column:
    """repr() of a JSON value; an object's members come by name, as a VARIANT
    keeps them."""
    return F.when(v.isNotNull(), json_repr(F.to_json(v)))


def variant_entries(entries: DataFrame) -> DataFrame:
    """Untyped entries (ord, name, value VARIANT) from a registry file."""
    v = F.col("value")
    url_v = F.variant_get(v, "$.url", "variant")
    ver_v = F.variant_get(v, "$.verified", "variant")
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    url_is_str = F.schema_of_variant(url_v) == "STRING"
    return entries.select(
        "ord", "name",
        is_obj.alias("is_object"),
        (is_obj & url_v.isNotNull()).alias("has_url"),
        (is_obj & ver_v.isNotNull()).alias("has_verified"),
        F.coalesce(url_is_str, F.lit(False)).alias("url_is_string"),
        F.when(url_is_str, F.variant_get(v, "$.url", "string")).alias("url"),
        _variant_repr(url_v).alias("url_repr"),
        F.coalesce(F.schema_of_variant(ver_v) == "BOOLEAN", F.lit(False)).alias("verified_is_bool"),
        _variant_repr(ver_v).alias("verified_repr"),
    )


def _fmt(template: str, **slots: Column) -> Column:
    """Fill a fixed message template with Column slots."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(pre), slots[key]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def registry_errors(entries: DataFrame) -> DataFrame:
    """I1–I11 → one row per error: ord, name, rule_seq, rule_id, message.

    Short-circuits follow the original: a blank name, a non-object entry,
    a missing url/verified, a non-string or invalid url end the row's
    checks; only rows that reach the URL checks take part in I10.
    """
    name, url = F.col("name"), F.col("url")
    blank = F.coalesce(F.length(py_strip(name)) == 0, F.lit(True))
    reach = (~blank & F.col("is_object") & F.col("has_url") & F.col("has_verified")
             & F.col("url_is_string") & is_valid_url(url))
    e = entries.withColumn("_reach", reach)
    owners = (e.where("_reach").groupBy("url")
              .agg(F.min_by(F.struct("ord", "name"), "ord").alias("_own")))
    e = e.join(owners, "url", "left")
    dup = F.col("_reach") & (F.col("_own.ord") != F.col("ord"))
    nrepr = py_repr(name)
    checks = [
        ("I1", blank, _fmt(cfg.MSG_BLANK_NAME, name_repr=F.coalesce(nrepr, F.lit("None")))),
        ("I2", ~blank & (name != py_strip(name)), _fmt(cfg.MSG_NAME_WHITESPACE, name_repr=nrepr)),
        ("I3", ~blank & ~F.col("is_object"), _fmt(cfg.MSG_NOT_OBJECT, name=name)),
        ("I4", ~blank & F.col("is_object") & ~F.col("has_url"), _fmt(cfg.MSG_MISSING_URL, name=name)),
        ("I5", ~blank & F.col("is_object") & F.col("has_url") & ~F.col("has_verified"),
         _fmt(cfg.MSG_MISSING_VERIFIED, name=name)),
        ("I6", ~blank & F.col("is_object") & F.col("has_url") & F.col("has_verified") & ~F.col("url_is_string"),
         _fmt(cfg.MSG_URL_NOT_STRING, name=name, url_repr=F.col("url_repr"))),
        ("I7", ~blank & F.col("is_object") & F.col("has_url") & F.col("has_verified") & F.col("url_is_string")
         & ~is_valid_url(url), _fmt(cfg.MSG_INVALID_URL, name=name, url=url)),
        ("I8", F.col("_reach") & is_tracking_url(url), _fmt(cfg.MSG_TRACKING, name=name, url=url)),
        ("I9", F.col("_reach") & is_generic_url(url), _fmt(cfg.MSG_GENERIC, name=name, url=url)),
        ("I10", dup, _fmt(cfg.MSG_DUPLICATE, name=name, first=F.col("_own.name"), url=url)),
        ("I11", F.col("_reach") & ~F.col("verified_is_bool"),
         _fmt(cfg.MSG_VERIFIED_NOT_BOOL, name=name, verified_repr=F.col("verified_repr"))),
    ]
    arr = F.array(*[F.when(cond, F.struct(F.lit(i + 1).alias("rule_seq"), F.lit(rid).alias("rule_id"),
                                          msg.alias("message")))
                    for i, (rid, cond, msg) in enumerate(checks)])
    return e.select("ord", "name", F.explode(F.array_compact(arr)).alias("err")) \
            .select("ord", "name", "err.rule_seq", "err.rule_id", "err.message")


def validation_rollup(errors: DataFrame, category: str = cfg.REGISTRY_CATEGORY) -> DataFrame:
    """per category, valid flag and error count (errors stay rows)."""
    return errors.agg(F.count(F.lit(1)).alias("n_errors")).select(
        F.lit(category).alias("category"), (F.col("n_errors") == 0).alias("is_valid"), "n_errors")


def validation_report(errors: DataFrame, categories: list[str]) -> DataFrame:
    """F13 over several categories: one row per error in file order —
    (category_no, category, is_valid, all_valid, n_errors, error_no, message) —
    and one without an error for each category that is valid.

    ``errors`` has category, ord, rule_seq, message.  The list of a category
    stays rows, numbered across key ranges, so no category is gathered in one
    task; the per-category counts are as many rows as there are categories."""
    spark = errors.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(categories)], "category_no int, category string")
    e = errors.select("category", "ord", "rule_seq", "message").join(F.broadcast(names), "category")
    ranked = stored(global_rank(e, [F.col("category_no"), F.col("ord"), F.col("rule_seq"), F.col("message")], "at", lead=[("category_no", True), ("ord", True)]), "errors")
    counts = ranked.groupBy("category").agg(F.count(F.lit(1)).alias("n_errors"), F.min("at").alias("first"))
    total = counts.select(F.coalesce(F.sum("n_errors"), F.lit(0))).scalar()
    flags = names.join(F.broadcast(counts), "category", "left").select(
        "category", "category_no", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "first", (total == 0).alias("all_valid"))
    return flags.join(ranked.select("category", "at", "message"), "category", "left").select(
        "category_no", "category", (F.col("n_errors") == 0).alias("is_valid"), "all_valid", "n_errors", (F.col("at") - F.col("first") + 1).alias("error_no"), "message")


def validation_listing(errors: DataFrame, category: str = cfg.REGISTRY_CATEGORY) -> DataFrame:
    """Listing lines in file order; line 0 is the category heading."""
    title = category.replace("_", " ").title()
    lines = global_rank(errors, ["ord", "rule_seq"], "line_no").select(
        "line_no", F.concat(F.lit("   • "), F.col("message")).alias("line"))
    head = errors.sparkSession.createDataFrame([(0, f"📁 {title}:")], "line_no long, line string")
    return head.unionByName(lines)
