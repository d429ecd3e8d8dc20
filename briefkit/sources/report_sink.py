"""Report sink (A8): ordered text part files, no single-task assembly."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame

from ..session import local_path


def write_report(rows: DataFrame, path: str, num_parts: int | None = None) -> str:
    """Write report lines as text part files range-partitioned on the line
    order: reading the parts in file-name order gives the report.  Each
    task writes a contiguous slice, so no task holds the whole report."""
    n = num_parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["section_ord", "part_ord", "line_ord"]
    (rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .select("line").write.mode("errorifexists").option("lineSep", "\n").text(path))
    return path


def concat_parts(path: str) -> str:
    """Read the parts back in order (small reports / tests)."""
    files = sorted(glob.glob(os.path.join(local_path(path), "part-*")))
    chunks = []
    for f in files:
        with open(f, encoding="utf-8") as fh:
            chunks.append(fh.read())
    text = "".join(chunks)
    return text[:-1] if text.endswith("\n") else text
