"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space of every operator here: space, tab, line feed, vertical tab,
#: form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"

#: Rows and bytes of one Arrow batch.  Texts may be long, so the default of
#: 10,000 rows would hold far too much in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and ship this package to the Python workers
    by value, so that executors need nothing beyond PySpark installed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    It cuts the lineage: a lost executor costs a reread of a shared file, and
    both uses of a table used twice see the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its extra columns renamed, so that no operator's column
    clashes with them, and what selects the columns of ``docs`` again."""
    own = ("doc_id", "text", "lang", "source", "n_chars")
    names = [c if c in own else f"extra_{i}_" for i, c in enumerate(docs.columns)]

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

    return docs.toDF(*names), back


def text_bytes(col: str | Column = "text") -> Column:
    """A text's UTF-8 bytes, those of the empty text for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``: the fold of a document."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(0)) % n
