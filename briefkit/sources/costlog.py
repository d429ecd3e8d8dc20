"""Cost-log source and sink (A3, A4).

The log is a commit log (``commitlog``): every append gets the next number, so
the rows have one order whoever wrote them, and lies in day partitions, so a
look-back lists and reads the days it needs only.  The original's form, one
JSON array in one file, is read too (``read_cost_log``) and can be imported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.sequence import global_rank
from ..session import exists, stored
from . import commitlog
from .jsonarray import read_json_arrays

_COST_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.COST.fields)
_STORED = f"{_COST_DDL}, pos long, seq long, day date"
#: Places that one append may have: ``ord`` = number of the append * PLACES + place.
PLACES = 1 << 40
#: Appends after which the log is compacted.
COMPACT_EVERY = 500


def read_cost_log(spark: SparkSession, path: str) -> DataFrame:
    """A3 / A4: the rows of a log with ``ord`` (append order) and
    ``_corrupt_record``; of a commit log also ``day``, its partition.

    ``path`` is a commit log, or a file or folder of the original's form: JSON
    arrays or JSON Lines, cut into ranges that are parsed by different tasks.
    Missing keys become NULL; a missing path gives an empty frame.  What does
    not parse is kept in ``_corrupt_record`` — quarantined, never dropped
    silently, never overwritten."""
    if commitlog.is_log(spark, path):
        return _read_commits(spark, path)
    if not exists(spark, path):
        return spark.createDataFrame([], f"ord long, {_COST_DDL}, _corrupt_record string")
    return read_json_arrays(spark, path, schemas.COST)


def _read_commits(spark: SparkSession, root: str) -> DataFrame:
    """``ord`` counts on from the number of the append, which a compacted row
    keeps and any other has from its folder."""
    seq = F.coalesce("seq", "_rank")
    return commitlog.read(spark, root, _STORED).select(
        (seq * F.lit(PLACES) + F.col("pos")).alias("ord"), *[f.name for f in schemas.COST.fields], F.lit(None).cast("string").alias("_corrupt_record"), "day")


def good_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def corrupt_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("_corrupt_record").isNotNull()).select("ord", "_corrupt_record")


def _write(rows: DataFrame, root: str, *place) -> str:
    """Rows by day and place, as files of a new folder; its name."""
    batch = commitlog.new_batch()
    out = rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.COST.fields], *place,
                      F.expr("try_cast(substring(timestamp, 1, 10) as date)").alias("day"))
    out.repartitionByRange("day", "pos").write.partitionBy("day").parquet(commitlog.batch_path(root, batch))
    return batch


def append_cost_rows(rows: DataFrame, path: str, order: str | None = None, compact_every: int = COMPACT_EVERY) -> int:
    """A4: append rows as the next commit of a log and return its number;
    nothing that is there is rewritten.  ``order`` names a numeric column that
    the rows are placed by; without it they keep the order of the frame's
    partitions, as the original appends one call after the other.  After
    ``compact_every`` appends the log is compacted."""
    spark = rows.sparkSession
    if not commitlog.is_log(spark, path) and exists(spark, path):
        raise ValueError(f"{path} is a log of the original's form; import_cost_log makes a commit log of it")
    if order:
        rows = global_rank(rows, [F.col(order), F.xxhash64(*rows.columns)], "_place", lead=[(order, True)])
    else:
        rows = global_rank(stored(rows.withColumn("_id", F.monotonically_increasing_id()), "append"), ["_id"], "_place")
    batch = _write(rows, path, F.col("_place").alias("pos"), F.lit(None).cast("long").alias("seq"))
    done = commitlog.commit(spark, path, batch)
    if len(commitlog.commits(spark, path)) > compact_every:
        compact_cost_log(spark, path)
    return done.seq


def compact_cost_log(spark: SparkSession, path: str) -> None:
    """Rewrite all appends so far as one folder of day partitions, in a new
    commit; ``ord`` stays, appends made meanwhile stay as they are."""
    live = commitlog.commits(spark, path)
    last = max([c.seq for c in live if c.upto is None] + [c.upto for c in live if c.upto is not None], default=0)
    if last:
        log = _read_commits(spark, path).where(F.col("ord") < (last + 1) * PLACES)
        batch = _write(log, path, F.col("ord").bitwiseAND(PLACES - 1).alias("pos"), F.shiftright("ord", 40).alias("seq"))
        commitlog.commit(spark, path, batch, upto=last)


def import_cost_log(spark: SparkSession, old: str, path: str) -> int:
    """Append a log of the original's form, in its order; corrupt rows stay
    where they are (``corrupt_rows`` of the old path)."""
    return append_cost_rows(good_rows(read_cost_log(spark, old)), path, order="ord")
