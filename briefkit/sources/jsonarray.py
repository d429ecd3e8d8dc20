"""JSON arrays and objects of any size, read by many tasks.

A JSON array is one value, but not one task's work.  The file is read as text
that ends at ``}``, which Spark's reader splits by byte ranges; so a range is a
run of fragments.  What a fragment means depends on all before it: whether it
starts inside a string, and how deep.  Both are sums: the quotes before it, and
the brackets outside strings before it, for which each fragment has two
answers, one for either start.  Each range adds up its fragments, the ranges'
totals (a row a range) are summed up in the order of the file, and so every
fragment learns its state without any task reading the whole file.  An element
ends at a ``}`` outside strings that comes back to depth 1; the number of such
ends before a fragment is the place of its element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import global_rank
from ..session import stored

#: Places of one file: ``ord`` = number of the file * PLACES + place.
PLACES = 1 << 40


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, id, value, quotes, flat, inside): text up to the next ``}``,
    its unescaped quotes, and its change of depth if it starts outside or
    inside a string."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value",
        F.col("_metadata.file_size").alias("size"))
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')

    def count(odd: int) -> Column:
        outside = F.array_join(F.filter(F.col("parts"), lambda p, i: i % 2 == odd), "")
        opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
        closed = F.length(outside) - F.length(F.translate(outside, "}]", ""))
        return opened - closed

    out = stored(raw.withColumn("parts", parts).select("file", "at", "id", "value", (F.size("parts") - 1).alias("quotes"),
                                                       count(0).alias("flat"), count(1).alias("inside"), "size"), "fragments")
    # the reader has no fragment after a } that ends the file: an empty one stands for it
    whole = out.groupBy("file").agg(F.max(F.struct("at", "id")).alias("m"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    zero = F.lit(0)
    after = whole.where("bytes = size").select("file", F.col("m.at").alias("at"), (F.col("m.id") + 1).alias("id"), F.lit("").alias("value"),
                                               zero.alias("quotes"), zero.alias("flat"), zero.alias("inside"))
    return out.drop("size").unionByName(after)


def _summed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all fragments of the file before
    this one.  Windows span one range; ranges meet by their totals."""
    here = Window.partitionBy("file", "at").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("file", "at").agg(F.sum(value).alias("_t"))
    totals = totals.select(F.col("file").alias("_file"), F.col("at").alias("_at"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    own = F.coalesce(F.sum(value).over(here), F.lit(0))
    return df.withColumn("_own", own).join(totals, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))) \
        .withColumn(name, F.col("_own") + F.col("_off")).drop("_own", "_file", "_at", "_off")


def _elements(fragments: DataFrame) -> DataFrame:
    """(file, place, text, whole, depth, open, last): the text up to the end of
    each element; the last row of a file is what follows its last element, with
    the depth and the string state that the file ends in.  The sums run over
    the fragments' counts; their texts meet the places once."""
    narrow = fragments.drop("value")
    end = narrow.groupBy("file").agg(F.max(F.struct("at", "id")).alias("_end"))
    x = narrow.join(F.broadcast(end), "file").withColumn("last", F.struct("at", "id") == F.col("_end")).drop("_end")   # a row a file
    x = stored(_summed(x, F.col("quotes"), "before"), "quoted")
    start, stop = F.col("before") % 2, (F.col("before") + F.col("quotes")) % 2
    x = x.withColumn("stop", stop).withColumn("change", F.when(start == 0, F.col("flat")).otherwise(F.col("inside"))
                                              - F.when((stop == 0) & ~F.col("last"), 1).otherwise(0))
    x = stored(_summed(x, F.col("change"), "depth"), "deep").withColumn("depth", F.col("depth") + F.col("change"))
    ends = ~F.col("last") & (F.col("stop") == 0) & (F.col("depth") == 1)
    x = _summed(x.withColumn("ends", ends.cast("int")), F.col("ends"), "place").select("file", "at", "id", "place", "ends", "depth", "stop", "last")
    x = fragments.select("file", "at", "id", "value").join(x, ["file", "at", "id"])
    text = F.expr("listagg(value, '}') WITHIN GROUP (ORDER BY at, id)")
    return x.groupBy("file", "place").agg(text.alias("text"), F.max("ends").alias("whole"), F.max_by("depth", F.struct("at", "id")).alias("depth"),
                                          F.max_by("stop", F.struct("at", "id")).alias("open"), F.max("last").alias("last"))


def _heads(fragments: DataFrame) -> DataFrame:
    """(file, head): the first character of each file that is no blank."""
    first = fragments.groupBy("file").agg(F.min_by("value", F.struct("at", "id")).alias("v"))
    return first.select("file", F.substring(F.regexp_replace("v", r"^\s+", ""), 1, 1).alias("head"))


def _files(df: DataFrame) -> DataFrame:
    """Number of each file, by its path (a row a file)."""
    return df.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("file_no"))


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType, salvage: bool = False, place: str = "ord") -> DataFrame:
    """The rows of JSON arrays of objects, and of JSON Lines, in files at
    ``path``: ``ord`` (file by file, place by place; or under the name
    ``place``), the columns of ``schema`` and ``_corrupt_record``.

    An array file is taken whole or not at all, as the original does: if any of
    it does not parse, its wrong elements are the only rows, each in
    ``_corrupt_record`` (with ``salvage`` its good elements are rows too).
    Lines stand for themselves.  Missing keys are NULL; an empty file or array
    has no rows."""
    pieces = _fragments(spark, path)
    head = stored(_heads(pieces), "heads")
    kind = stored(head.join(_files(head), "file").select("file", "file_no", (F.col("head") == "[").alias("array")), "files")
    arrays = pieces.join(kind.where("array").select("file"), "file", "left_semi")

    row = T.StructType(schema.fields).simpleString()
    found = _elements(arrays)
    rest = F.regexp_replace("text", r"^[\s,\[]+", "")
    body = F.when(F.col("whole") == 1, F.concat(rest, F.lit("}")))
    one = found.select("file", "place", F.coalesce(body, rest).alias("text"), F.coalesce(F.from_json(body, row).isNotNull() & F.try_parse_json(body).isNotNull(), F.lit(False)).alias("good"),
                       (F.col("last") & F.rlike(rest, F.lit(r"^\s*\]\s*\z")) & (F.col("depth") == 0) & (F.col("open") == 0)).alias("tail"))
    one = stored(one.where(~F.col("tail")), "elements")
    bad = one.where(~F.col("good")).select("file").distinct()
    good = one.where("good")
    good = good if salvage else good.join(bad, "file", "left_anti")
    wanted = good.unionByName(one.where(~F.col("good")))

    lines = kind.where(~F.col("array"))
    if lines.limit(1).count():
        text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                            F.monotonically_increasing_id().alias("id"), F.trim("value").alias("text"))
        text = stored(text.join(lines.select("file"), "file", "left_semi").where("text <> ''"), "lines")
        text = _summed(text.withColumn("one", F.lit(1)), F.col("one"), "place")
        ok = F.coalesce(F.try_parse_json("text").isNotNull(), F.lit(False))
        wanted = wanted.select("file", "place", "text", "good").unionByName(text.select("file", "place", "text", ok.alias("good")))
    parsed = F.when(F.col("good"), F.from_json("text", row))
    return wanted.join(kind.select("file", "file_no"), "file").select(
        (F.col("file_no") * F.lit(PLACES) + F.col("place")).alias("_at"), parsed.alias("r"), F.when(~F.col("good"), F.col("text")).alias("_corrupt_record")) \
        .select(F.col("_at").alias(place), *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields], "_corrupt_record")


def read_json_members(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON object of any size in one file, as (faults, members).

    ``members``: (ord, name, json), one row a name in the order of the file,
    its value as text; a name that comes again has its last value, as the
    original's parser keeps it.  ``faults``: one row (fault), ``invalid`` or
    ``no object``, if the file is not one JSON object; then it has no members.
    An element is an object at depth 1 with what stands before it, so a row
    holds one such value and the plain ones since the last."""
    pieces = _fragments(spark, path)
    found = _elements(pieces)
    rest = F.when(F.col("place") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    close = F.when(F.col("whole") == 1, "}}").otherwise("")
    body = F.concat(F.lit("{"), rest, close)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    end = F.col("last") & (F.col("depth") == 0) & (F.col("open") == 0) & F.rlike(body, F.lit(r"\}\s*\z"))
    # a row but the last ends with its element; the last with the file
    x = stored(found.select("place", body.alias("body"), (is_object & (end | ~F.col("last"))).alias("good"), F.regexp_replace("text", r"^\s+", "").startswith("{").alias("braced")), "members")
    wrong = x.where(~F.col("good") | ((F.col("place") == 0) & ~F.col("braced")))
    broken = wrong.limit(1).count() > 0
    if not broken:
        each = x.select("place", F.posexplode(F.from_json("body", "map<string,variant>")).alias("pos", "name", "value"))
        each = each.select("place", "pos", "name", F.to_json("value").alias("json"))
        at = F.struct("place", "pos")
        once = each.groupBy("name").agg(F.min(at).alias("first"), F.max_by("json", at).alias("json"))
        once = once.select("name", "json", F.col("first.place").alias("place"), F.col("first.pos").alias("pos"))
        ranked = global_rank(stored(once, "names"), ["place", "pos"], "rank", lead=[("place", True), ("pos", True)])
        return spark.createDataFrame([], "fault string"), ranked.select((F.col("rank") - 1).alias("ord"), "name", "json")
    head = _heads(pieces).first()
    none = spark.createDataFrame([], "ord long, name string, json string")
    if head is None or head["head"] == "{":
        return spark.createDataFrame([("invalid",)], "fault string"), none
    whole = spark.read.option("wholetext", True).text(path)   # no object: a valid value or not
    return whole.select(F.when(F.try_parse_json("value").isNull(), "invalid").otherwise("no object").alias("fault")), none
