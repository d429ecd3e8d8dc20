"""Report assembly (K1–K5, F6, A8 stem) as ordered rows.

The report is a table ``(section_ord, part_ord, line_ord, line)``; joining
its lines with '\\n' in that order gives the markdown text.  Sections:

    0 front matter (optional)   5 analysis lines
    1 title                     6 latest developments (only when non-empty)
    2 model line (optional)     7 sources heading
    3 date range                8 source lines
    4 analysis heading          9 methodology

No section is assembled in one task: list sections keep one row per line,
ordered by a rank, and the sink writes range-partitioned part files.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..operators import sites, stats
from ..session import stored

ROW = "section_ord int, part_ord long, line_ord long, line string"
SECTIONS = {"front": 0, "title": 1, "model": 2, "range": 3, "analysis_head": 4, "analysis": 5,
            "latest": 6, "sources_head": 7, "sources": 8, "methodology": 9}


@dataclass
class ReportParams:
    run_ts: dt.datetime
    days: int = cfg.DEFAULT_DAYS
    model_label: str | None = None
    model_ts: str | None = None      # ISO timestamp of the model call
    include_latest: bool = True      # K3
    front_matter: bool = False       # K4 (only when writing to an output folder)


def _lines(spark: SparkSession, section: str, lines: list[str], part: int = 0) -> DataFrame:
    rows = [(SECTIONS[section], part, i, ln) for i, ln in enumerate(lines)]
    return spark.createDataFrame(rows, ROW)


def _one(df: DataFrame, section: str, line_col: str, part: int = 0, line_ord: int = 0) -> DataFrame:
    return df.select(F.lit(SECTIONS[section]).alias("section_ord"), F.lit(part).cast("long").alias("part_ord"),
                     F.lit(line_ord).cast("long").alias("line_ord"), F.col(line_col).alias("line"))


def analysis_rows(analysis: DataFrame) -> DataFrame:
    """Analysis text(s) ``(batch_id, text)`` → one row per line."""
    x = analysis.select("batch_id", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    return x.select(F.lit(SECTIONS["analysis"]).alias("section_ord"), F.col("batch_id").cast("long").alias("part_ord"),
                    F.col("pos").cast("long").alias("line_ord"), "line")


def build_report(records: DataFrame, analysis: DataFrame, registry: DataFrame | None, curated: DataFrame,
                 p: ReportParams) -> DataFrame:
    """K1–K5: every section of the report as rows.

    The records without their bodies, with their dates parsed, are written
    once: dates, latest items, counts and ranks all read that narrow table,
    and the bodies are read in the one pass that looks up first records."""
    spark = records.sparkSession
    bodies = [c for c in ("body", "body_format", "cleaned") if c in records.columns]
    parsed = stored(stats.parse_dates(records.drop(*bodies)), "dated")
    extent = stats.range_label(stats.date_extent(parsed), p.run_ts, p.days)
    sources = stats.issues_per_source(records, parsed)
    totals = stats.source_totals(parsed)
    parts: list[DataFrame] = []

    if p.front_matter:
        title = cfg.FRONT_MATTER_TITLE.format(date=p.run_ts.strftime("%B %d, %Y"))
        parts.append(_lines(spark, "front", ["---", "layout: default", f"title: {title}", "---", ""]))
    parts.append(_lines(spark, "title", [cfg.REPORT_TITLE]))
    if p.model_label:
        parts.append(_lines(spark, "model", [cfg.REPORT_MODEL_LINE.format(model=p.model_label), ""]))
    parts.append(_one(extent, "range", "range_line"))
    parts.append(_lines(spark, "range", [""], part=1))
    parts.append(_lines(spark, "analysis_head", [cfg.REPORT_ANALYSIS_HEADING, ""]))
    parts.append(analysis_rows(analysis))

    if p.include_latest:
        latest = stats.latest_lines(stats.latest_slice(parsed))
        n_latest = latest.select(F.count(F.lit(1))).scalar()
        head = _lines(spark, "latest", ["", cfg.REPORT_LATEST_HEADING, "", cfg.REPORT_LATEST_INTRO, ""])
        parts.append(head.where(n_latest > 0))
        parts.append(latest.select(F.lit(SECTIONS["latest"]).alias("section_ord"), F.lit(1).cast("long").alias("part_ord"),
                                   F.col("ord").cast("long").alias("line_ord"), "line"))

    pre, rest = cfg.REPORT_SOURCES_INTRO.split("{n}")
    mid, post = rest.split("{s}")
    intro = F.concat(F.lit(pre), F.col("n_messages").cast("string"), F.lit(mid),
                     F.col("n_sources").cast("string"), F.lit(post))
    parts.append(_lines(spark, "sources_head", [cfg.REPORT_SOURCES_HEADING, ""]))
    parts.append(_one(totals.select(intro.alias("l")), "sources_head", "l", part=1))
    parts.append(_lines(spark, "sources_head", [""], part=2))
    resolved = sites.resolve_homepages(sources, registry, curated)
    parts.append(sites.source_lines(resolved).select(
        F.lit(SECTIONS["sources"]).alias("section_ord"), F.lit(0).cast("long").alias("part_ord"),
        F.col("rank").cast("long").alias("line_ord"), "line"))

    meth = cfg.REPORT_METHODOLOGY
    if p.model_label and p.model_ts:
        ts = dt.datetime.fromisoformat(p.model_ts).strftime("%Y-%m-%d %H:%M:%S")
        meth += cfg.REPORT_METHODOLOGY_MODEL.format(model=p.model_label, ts=ts)
    parts.append(_lines(spark, "methodology", ["", cfg.REPORT_METHODOLOGY_HEADING, meth]))

    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def report_file_name(records: DataFrame, p: ReportParams) -> DataFrame:
    """The file name (one row)."""
    return stats.range_label(stats.date_extent(stats.parse_dates(records)), p.run_ts, p.days).select("file_name")


def report_text(rows: DataFrame) -> DataFrame:
    """The whole markdown text in one row.  For small reports and tests
    only: it is one group by construction; large reports go through
    ``sources.report_sink.write_report``."""
    return rows.agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY section_ord, part_ord, line_ord)").alias("text"))
