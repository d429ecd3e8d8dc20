"""Report assembly (K1–K5, A8) against the original's text layout."""

import datetime as dt
import glob
import os

from briefkit import config as cfg
from briefkit.operators import sites
from briefkit.plans import report as R
from briefkit.sources.report_sink import concat_parts, write_report

REC = "ord long, subject string, date string, sender string, body string, body_format string"
ROWS = [
    (0, "[AI] Weekly: Launches New Model", "Mon, 01 Jan 2024 10:00:00 +0000", "Alpha News <hello@alphanews.com>", "", None),
    (1, "Quiet update", "Mon, 01 Jan 2024 20:00:00 +0000", "Beta <b@mail.beta.io>", "https://beta.io/", None),
    (2, "More", "Tue, 02 Jan 2024 09:00:00 +0000", "Alpha News <hello@alphanews.com>", "", None),
]
RUN = dt.datetime(2024, 1, 3, 8, 0)


def expected(model=True, latest=True):
    # The original's layout, written out.
    txt = "# MESSAGE DIGEST\n"
    if model:
        txt += "## Generated with gpt-x\n\n"
    txt += "## January 01 to January 02, 2024, 09:00 (summary run at 2024-01-03 08:00)\n\n"
    txt += "## TOP AI DEVELOPMENTS\n\n### 1. Topic\nbody\n"
    if latest:
        txt += ("\n## JUST IN: LATEST DEVELOPMENTS\n\nThese items are from the most recent newsletters (last 24 hours) "
                "and may represent emerging trends:\n\n- 🔥 **Launches New Model** (via Alpha News)\n"
                "- Quiet update (via Beta)\n- More (via Alpha News)\n")
    txt += ("## NEWSLETTER SOURCES\n\nThis week's insights were gathered from 3 newsletters across 2 sources:\n\n"
            "- [Alpha News](https://alphanews.com) - 2 issues\n- [Beta](https://beta.io) - 1 issues\n")
    txt += "\n## METHODOLOGY\n" + cfg.REPORT_METHODOLOGY
    if model:
        txt += " Analysis performed using gpt-x on 2024-01-03 07:59:00."
    return txt


def build(spark, **kw):
    recs = spark.createDataFrame(ROWS, REC)
    analysis = spark.createDataFrame([(0, "### 1. Topic\nbody")], "batch_id long, text string")
    p = R.ReportParams(run_ts=RUN, days=7, **kw)
    return R.build_report(recs, analysis, None, sites.curated_sites(spark), p)


def test_full_text(spark):
    rows = build(spark, model_label="gpt-x", model_ts="2024-01-03T07:59:00.5")
    assert R.report_text(rows).first().text == expected()


def test_toggle_and_front_matter(spark):
    rows = build(spark, include_latest=False, front_matter=True)
    text = R.report_text(rows).first().text
    assert text == "---\nlayout: default\ntitle: Message digest - January 03, 2024\n---\n\n" + \
        expected(model=False, latest=False)


def test_sink_writes_ordered_parts(spark, tmp_dir):
    rows = build(spark, model_label="gpt-x", model_ts="2024-01-03T07:59:00")
    out = write_report(rows, os.path.join(tmp_dir, "report"), num_parts=3)
    assert len(glob.glob(os.path.join(out, "part-*"))) >= 2
    assert concat_parts(out) == expected()
    name = R.report_file_name(spark.createDataFrame(ROWS, REC), R.ReportParams(run_ts=RUN)).first().file_name
    assert name == "message_digest_20240103_0800_from_20240101.md"
