"""Site registry source and versioned sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from .. import schemas
from ..operators.sequence import global_rank
from ..session import children, exists
from .jsonarray import read_json_members

EMPTY = "name string, url string, verified boolean"


def read_registry_file(spark: SparkSession, path: str) -> DataFrame:
    """A5: a JSON object {name: {url, verified}} → (ord, name, url, verified).
    A missing file, or one that is no JSON object, is empty.  The file is read
    by several tasks (``jsonarray``)."""
    if not exists(spark, path):
        return spark.createDataFrame([], EMPTY).withColumn("ord", F.lit(None).cast("long"))
    _, members = read_json_members(spark, path)
    return members.select("ord", "name", F.from_json("json", schemas.REGISTRY_ENTRY).alias("e")) \
        .select("ord", "name", F.col("e.url").alias("url"), F.col("e.verified").alias("verified"))


def registry_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """I12 + untyped entries for the quality rules.

    Returns (file_errors, entries): file_errors has one row (category,
    message) when the file is missing, is not JSON, or its root is not an
    object; entries are (ord, name, value VARIANT) otherwise.
    """
    if _versions(spark, path) or "_SUCCESS" in children(spark, path):
        return spark.createDataFrame([], "category string, message string"), export_registry(spark, path)
    if not exists(spark, path):
        err = spark.createDataFrame([(cfg.REGISTRY_CATEGORY, cfg.MSG_FILE_MISSING.format(path=path))],
                                    "category string, message string")
        return err, spark.createDataFrame([], "ord long, name string").withColumn("value", F.parse_json(F.lit("null")))
    faults, members = read_json_members(spark, path)
    message = F.when(F.col("fault") == "invalid", F.lit(cfg.MSG_BAD_JSON.format(path=path, err="parse error"))).otherwise(F.lit(cfg.MSG_ROOT_NOT_OBJECT.format(path=path)))
    return faults.select(F.lit(cfg.REGISTRY_CATEGORY).alias("category"), message.alias("message")), \
        members.select("ord", "name", F.parse_json("json").alias("value"))


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of finished versions, the oldest first."""
    root = root.rstrip("/")
    return [f"{root}/{v}" for v in children(spark, root) if v.startswith("v-") and exists(spark, f"{root}/{v}/_SUCCESS")]


def write_registry_version(df: DataFrame, root: str) -> str:
    """Write the merged registry as the next version folder and return it.
    A version is valid once its writer has finished (``_SUCCESS``); the version
    being read is never overwritten.  Two writers at once give two versions
    with one number, of which the greater name counts."""
    spark = df.sparkSession
    taken = [int(v.rpartition("/")[2].split("-")[1]) for v in _versions(spark, root)]
    path = f"{root.rstrip('/')}/v-{max(taken, default=0) + 1:010d}-{uuid.uuid4().hex}"
    df.select("name", "url", "verified").write.mode("errorifexists").parquet(path)
    return path


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A5: (ord, name, url, verified) of a registry file, of one version's
    folder, or of the newest version below a folder that
    ``write_registry_version`` fills."""
    found = _versions(spark, path) or ([path] if "_SUCCESS" in children(spark, path) else [])
    if not found:
        return read_registry_file(spark, path)
    return spark.read.parquet(found[-1]).select(F.lit(None).cast("long").alias("ord"), "name", "url", "verified")


def export_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the newest version as (ord, name, value VARIANT), as
    ``registry_entries`` gives those of a file; ``ord`` follows the names."""
    entry = F.to_json(F.struct("url", "verified"), {"ignoreNullFields": "false"})
    named = global_rank(read_registry(spark, path).select("name", entry.alias("entry"), F.xxhash64("name").alias("_k")),
                        ["_k", "name"], "ord", lead=[("_k", True)])
    return named.select("ord", "name", F.parse_json("entry").alias("value"))
