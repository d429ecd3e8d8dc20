"""Adapters from the driver's tables to the engine's inputs.

The driver tables are TPC-H-style synthetic data, not mailboxes; these
adapters derive the engine's inputs from them with plain projections and
joins, over whole tables:

* ``messages``  — one newsletter message per ``events`` row; the event's
  ``user_id`` names the ``pages`` row that is the issue's web page
  (``user_id`` < page count at every scale).  Date-header shapes and
  subject shapes vary with ``event_type``.
* ``cost_log``  — one model call per ``events`` row.
* ``registry``  — one site per page label, as the registry file holds it.
* ``curated``   — sites served from a ``www.`` host, as a curated list.
* ``site_rows`` — one registry row per page, for the data-quality rules.
* ``markup``    — one HTML body per document that holds its lines in nested
  lists, a quote, a table and marks, and ends in an unclosed script.
* ``chat_records`` — one message record per conversation turn, with texts that
  hold quotes, brackets and backslashes.
* ``untyped_entries`` — one registry entry per page with wrong or missing types.
* ``chat_messages`` — one message record per conversation turn.
* ``decisions`` — review decisions derived from the registry rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan that yields fewer partitions than the cluster has
    cores (a small single-row-group file), so per-row work downstream runs
    on every core.  A scan that is already parallel (the large-data case)
    is returned as is: no extra shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n, key)
    return df


def dealt(df: DataFrame) -> DataFrame:
    """Deal a scan's rows out evenly, for queries with much work a row: one
    task reads a whole row group, however many splits its file has."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def page_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(read_table(spark, sf_dir, "pages"), "page_id")
    return p.select(
        "page_id", "url", "html",
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"([a-z-]+)[.]example[.]", 1).alias("site"),
        F.regexp_extract("html", r"<title>([^<]*)", 1).alias("title"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newsletter records (M2) plus label, recipient and the event time."""
    e = spread(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"),
               "event_id")
    p = page_sites(spark, sf_dir)
    et, ts = F.col("event_type"), F.col("ts")
    subject = (F.when(et == "signup", F.concat(F.lit("["), F.col("site"), F.lit("] New release: "), F.col("title")))
               .when(et == "purchase", F.concat(F.col("site"), F.lit(" Weekly: "), F.col("title")))
               .otherwise(F.col("title")))
    date = (F.when(et == "view", F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
            .when(et == "click", F.concat(F.date_format(ts - F.expr("INTERVAL 5 HOURS"), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" EST")))
            .when(et == "signup", F.concat(F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" -0000")))
            .when(et == "purchase", F.concat(F.date_format(ts + F.expr("INTERVAL 330 MINUTES"), "EEE, dd MMM yy HH:mm"), F.lit(" +0530 (IST)")))
            .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")))
    sender = (F.when(F.col("host").startswith("blog."), F.concat(F.lit("news@"), F.col("host")))
              .when(F.col("url").startswith("http:"), F.concat(F.col("site"), F.lit(" Daily <news@mail."), F.col("host"), F.lit(">")))
              .otherwise(F.concat(F.col("site"), F.lit(" <news@mail."), F.col("host"), F.lit(">"))))
    body = F.concat(
        F.col("html"), F.lit("<p>Read online: https://t.track.example.com/c?e="), F.col("event_id").cast("string"),
        F.lit(" "), F.col("url"),
        F.when(et.isin("view", "click"), F.concat(F.lit(" https://"), F.col("host"), F.lit("/"))).otherwise(F.lit("")),
        F.lit("</p>"))
    return e.join(p, e.user_id == p.page_id).select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("msg_id"),
        et.alias("label"),
        subject.alias("subject"),
        date.alias("date"),
        sender.alias("sender"),
        F.concat(F.lit("reader"), F.regexp_extract("props", "[0-9]+", 0), F.lit("@inbox.example.org")).alias("recipient"),
        body.alias("body"),
        F.lit("html").alias("body_format"),
        F.col("ts").cast("timestamp").alias("received_ts"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Just the M2 record columns."""
    return messages(spark, sf_dir).select(*[f.name for f in schemas.RECORD.fields])


def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged model call per event (M9) with its log position."""
    e = read_table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    return e.select(
        F.col("event_id").alias("ord"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit("m"), F.regexp_extract("props", "[0-9]", 0)).alias("model"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("provider"),
        F.col("user_id").alias("prompt_tokens"),
        k.alias("completion_tokens"),
        (F.col("user_id") + k).alias("total_tokens"),
        F.col("value").alias("cost"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry entry per site label."""
    return (page_sites(spark, sf_dir).groupBy(F.col("site").alias("name"))
            .agg(F.min("url").alias("url"))
            .withColumn("verified", F.col("url").startswith("https://")))


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curated list (M11): sites served from a www. host, in page order."""
    return (page_sites(spark, sf_dir).where(F.col("host").startswith("www."))
            .groupBy(F.col("site").alias("name"))
            .agg(F.min("page_id").alias("ord"))
            .withColumn("url", F.concat(F.lit("https://www."), F.col("name"), F.lit(".example.com"))))


def site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed registry rows for the quality rules, one per page."""
    p = page_sites(spark, sf_dir)
    url = (F.when(F.col("url").startswith("http://www."), F.regexp_replace("url", "^http://", "ftp://"))
           .when(F.col("url").contains("page=2"), F.lit("https://substack.com"))
           .when(F.col("url").endswith(".html"), F.concat(F.lit("https://"), F.col("host"), F.lit("/")))
           .otherwise(F.col("url")))
    name = F.concat(F.col("site"), F.lit("-"), F.col("page_id").cast("string"),
                    F.when(F.col("url").endswith("#top"), F.lit(" ")).otherwise(F.lit("")))
    return p.select(F.col("page_id").alias("ord"), name.alias("name"), url.alias("url"),
                    F.col("url").startswith("https://").alias("verified"))


def decisions(reg: DataFrame) -> DataFrame:
    """Review decisions (M16) for the unverified registry rows."""
    u = F.col("url")
    action = (F.when(u.contains("utm_"), F.lit("e"))
              .when(u.contains("blog."), F.lit(" D "))
              .when(u.contains("#top"), F.lit("A"))
              .when(u.contains("page=2"), F.lit("x"))
              .otherwise(F.lit("s")))
    new_url = F.when(u.contains("utm_"), F.regexp_replace(u, r"\?.*$", ""))
    return reg.where(~F.coalesce(F.col("verified"), F.lit(False))).select("name", action.alias("action"), new_url.alias("new_url"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses (M7) from conversations: each assistant turn is the
    reply to the user turn before it; usage counts come from text lengths."""
    c = read_table(spark, sf_dir, "conversations")
    a = c.where(F.col("role") == "assistant")
    content = F.col("text")
    usage = F.when(F.col("turn") > 1, F.struct(
        (F.length("text") + F.col("turn")).cast("bigint").alias("total_tokens"),
        F.col("turn").cast("bigint").alias("prompt_tokens"),
        F.length("text").cast("bigint").alias("completion_tokens"),
        (F.length("text") / F.lit(1000.0)).alias("cost")))
    return a.select(
        "conv_id", "turn",
        F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
                           usage.alias("usage"))).alias("response"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model analysis texts from documents: one '### n. ' heading per doc."""
    d = read_table(spark, sf_dir, "documents")
    indent = F.when(F.col("lang") == "de", F.lit("  ")).otherwise(F.lit(""))
    return d.select("doc_id", F.concat(indent, F.lit("### "), F.col("doc_id").cast("string"), F.lit(". "),
                                       F.col("text")).alias("analysis"))


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, html): each document's lines (a-z and single spaces only; the
    line ``none`` if there is none) as structured markup."""
    plain = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z ]", ""), " +", " ")))
    lines = F.filter(plain, lambda x: x != "")
    d = dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("none"))).alias("lines"))
    a, z = F.get("lines", 0), F.element_at("lines", -1)
    rows = F.transform("lines", lambda x, i: F.concat(F.lit("<tr class=r><td>"), (i + 1).cast("string"), F.lit("<td align='left'>"), x, F.lit("</td></tr>")))
    html = F.concat(
        F.lit('<div class="body"><h2 id=t>'), a, F.lit("</h2><p>by <b>"), a, F.lit(" </b>and <em>"), z, F.lit("</em></p>"),
        F.lit('<ol start="3"><li>'), a, F.lit("<UL><li>"), F.array_join("lines", "</li><li>"), F.lit("</UL><li><strong>"), z, F.lit("</strong></ol>"),
        F.lit("<blockquote><p>"), a, F.lit("</p><p>"), z, F.lit("</p></blockquote>"),
        F.lit("<table><tr><th>line</th><th>text</th></tr>"), F.array_join(rows, ""), F.lit("</table>"),
        F.lit('<p>&#233;&eacute;&#x20AC;&hellip; &lt;b&gt; &unknown;</p><script>var t = "</p>'), a)
    return d.select("doc_id", html.alias("html"))


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_no, place, subject, date, sender, body): 64 conversations a file."""
    c = read_table(spark, sf_dir, "conversations")
    body = F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit('\n"}], {\\" [')).otherwise(F.lit("}\\\\")))
    return c.select(F.floor(F.col("conv_id") / 64).alias("file_no"), ((F.col("conv_id") % 64) * 1000 + F.col("turn")).alias("place"),
                    F.concat(F.lit("{"), F.col("role")).alias("subject"), F.col("conv_id").cast("string").alias("date"),
                    F.concat(F.col("role"), F.lit(" <a@b.c>")).alias("sender"), body.alias("body"))


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """One JSON array a file, of the rows of each ``file_no`` by ``place``."""
    here = Window.partitionBy("file_no").orderBy("place")
    text = F.to_json(F.struct(*[c for c in rows.columns if c not in ("file_no", "place")]))
    first, last = F.row_number().over(here) == 1, F.lead("place").over(here).isNull()
    lines = rows.select("file_no", "place", F.concat(F.when(first, "[").otherwise(""), text, F.when(last, "]").otherwise(",")).alias("line"))
    named = lines.withColumn("file", F.lpad(F.col("file_no").cast("string"), 12, "0"))
    named.repartition("file").sortWithinPartitions("file", "place").select("line", "file").write.partitionBy("file").text(path)


def untyped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, name, value VARIANT): one entry per page, most of them wrong, each
    page number in its own way."""
    p = page_sites(spark, sf_dir)
    k = F.col("page_id") % 10
    url = F.concat(F.lit("https://"), F.col("site"), F.lit(".example.com/p"), F.col("page_id").cast("string"))
    json = (F.when(k == 0, F.concat(F.lit('{"url": "'), url, F.lit('", "verified": true}'))).when(k == 1, '["a", "b"]').when(k == 2, '"text"')
            .when(k == 3, '{"verified": true}').when(k == 4, F.concat(F.lit('{"url": "'), url, F.lit('"}'))).when(k == 5, '{"url": 5, "verified": true}')
            .when(k == 6, '{"url": null, "verified": true}').when(k == 7, F.concat(F.lit('{"url": "'), url, F.lit('", "verified": "yes"}')))
            .when(k == 8, F.concat(F.lit('{"url": "'), url, F.lit('", "verified": null}'))).otherwise('{"url": ["a", "b"], "verified": false}'))
    name = F.when(k == 0, "  ").otherwise(F.concat(F.col("site"), F.lit("-"), F.col("page_id").cast("string")))
    return p.select(F.col("page_id").alias("ord"), name.alias("name"), F.parse_json(json).alias("value"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message record per conversation turn: the subject is the text's
    first word, the sender the role."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.substring_index("text", " ", 1).alias("subject"), F.col("conv_id").cast("string").alias("date"),
                    F.concat(F.col("role"), F.lit(" <a@b.c>")).alias("sender"), F.col("text").alias("body"), F.lit("plain").alias("body_format"))
