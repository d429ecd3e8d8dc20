"""Message sources (A1, A2) and the message-resource writer used by tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.parse import parse_messages
from .jsonarray import read_json_arrays


def read_message_resources(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A1: exported message resources (JSON Lines or Parquet), fixed schema.
    A line that does not parse is kept in ``_corrupt_record``; the parse marks
    it ``decode_ok = false``, which is what the quarantine holds."""
    if fmt == "parquet":
        return spark.read.schema(schemas.MESSAGE).parquet(path)
    return spark.read.schema(schemas.MESSAGE_LINE).option("mode", "PERMISSIVE").json(path)


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A1 + C1–C5: scan and parse into flat records."""
    return parse_messages(read_message_resources(spark, path, fmt))


def read_records_json(spark: SparkSession, path: str) -> DataFrame:
    """A2: JSON arrays (or JSON Lines) of records; missing keys are NULL.  A
    file is read by several tasks.  ``ord`` is the file's own where it has one,
    else file by file the place in the list; text that does not parse is in
    ``_corrupt_record``."""
    r = read_json_arrays(spark, path, schemas.RECORD, place="_place")
    return r.withColumn("ord", F.coalesce("ord", "_place")).drop("_place")


def records_from_json_text(spark: SparkSession, text: str) -> DataFrame:
    """A2 for an inline JSON array (the mock-data path): parsed on the JVM,
    list position becomes ``ord``."""
    arr = F.from_json(F.lit(text), "array<struct<subject:string,date:string,sender:string,body:string,body_format:string>>")
    return spark.range(1).select(F.posexplode(arr).alias("ord", "r")).select(
        F.col("ord").cast("long").alias("ord"), "r.subject", "r.date", "r.sender", "r.body", "r.body_format")


def b64url(c: Column) -> Column:
    """UTF-8 text → base64url without line breaks."""
    plain = F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))
    return F.replace(F.replace(plain, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


def to_message_resources(msgs: DataFrame) -> DataFrame:
    """Render records as M1 resources; the part layout varies by label so
    every body-choice branch (C2/C4) is exercised:
    view/click → plain + html parts; signup → plain part only;
    purchase → direct body; other → no body and no Subject header."""
    lab = F.col("label")

    def h(name: str, col: str) -> Column:
        return F.struct(F.lit(name).alias("name"), F.col(col).alias("value"))

    headers = F.when(lab == "error", F.array(h("Date", "date"), h("From", "sender"), h("To", "recipient"))) \
               .otherwise(F.array(h("Subject", "subject"), h("Date", "date"), h("From", "sender"), h("To", "recipient")))

    def part(mime: str, c: Column) -> Column:
        return F.struct(F.lit(mime).alias("mimeType"), F.struct(b64url(c).alias("data")).alias("body"))

    plain_text = F.concat(F.col("subject"), F.lit("\n"), F.col("recipient"))
    parts = (F.when(lab.isin("view", "click"), F.array(part("text/plain", F.col("subject")), part("text/html", F.col("body"))))
             .when(lab == "signup", F.array(part("text/plain", plain_text))))
    body = F.when(lab == "purchase", F.struct(b64url(F.col("subject")).alias("data")))
    return msgs.select(
        F.col("msg_id").alias("id"),
        F.array(lab).alias("labelIds"),
        (F.unix_millis(F.col("received_ts"))).alias("internalDate"),
        F.struct(headers.alias("headers"), parts.alias("parts"), body.alias("body")).alias("payload"),
    )

