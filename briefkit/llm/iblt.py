"""Document fingerprints as invertible Bloom lookup sketches, in SQL functions.

A text is the set of its paragraphs' digests (its lines; a line that repeats
is one digest with its count).  Its sketch has ``CELLS`` cells in three
tables; every digest is added to one cell of each: a count, the XOR of the
digests and the XOR of their checks.  The sketches of two versions subtract
cell by cell, what both hold cancels, and peeling recovers the digests that
differ: a cell that holds one digest gives it away, and taking that out of its
other cells frees further ones.

If peeling gets stuck, both are sketched again with twice as many groups of
cells (a digest goes to the group that its check's low bits name, so that the
work stays in proportion to the paragraphs) until it succeeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import let
from .shared import prepare, stored

TABLES, WIDTH = 3, 16
CELLS = TABLES * WIDTH
#: Paragraphs of both versions together that a group of cells is first given.
LOAD = 16


def paragraph_digests(text: Column) -> Column:
    """Sorted distinct digests of a text's lines; a line's digest holds how
    often it occurs, so that texts with other repeats differ."""
    def runs(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        return let(starts, lambda s: F.transform(
            s, lambda at, k: F.xxhash64(F.get(h, at), F.coalesce(F.get(s, k + 1), F.size(h)) - at)))

    lines = F.split(text, "\n", -1)
    return let(F.array_sort(F.transform(lines, lambda x: F.xxhash64(x))), runs)


def _cells_of(x: Column, salt: int) -> Column:
    """A digest's cell in each of the tables, array of int."""
    def at(h: Column) -> Column:
        return F.array(*[F.shiftright(h, 20 * j).bitwiseAND(F.lit(WIDTH - 1)).cast("int") + WIDTH * j for j in range(TABLES)])

    return let(F.xxhash64(x, F.lit(salt)), at)


def cells(rows: DataFrame, salt: int = 0) -> DataFrame:
    """(id, side, groups, digests, sign) → (id, side, g, p, n, x, y): the cells
    of each id and side that are not zero, sketches of sign -1 subtracted from
    those of sign 1.  ``rows`` hashed by id need no further shuffle."""
    one = rows.select("id", "side", "groups", "sign", F.explode("digests").alias("x")).withColumn("y", F.xxhash64("x"))
    three = one.select("id", "side", F.col("y").bitwiseAND(F.col("groups") - 1).alias("g"), "sign", "x", "y",
                       F.explode(_cells_of(F.col("x"), salt)).alias("p"))
    return three.groupBy("id", "side", "g", "p").agg(F.sum("sign").cast("int").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")) \
                .where("n != 0 or x != 0")


def peeled(cells: Column, salt: int = 0) -> Column:
    """How many digests a difference's cells hold, array of (p, n, x, y); null
    if peeling gets stuck.  Each round takes out the digests that are alone in
    a cell, from all their cells."""
    def alone(c: Column) -> Column:
        pure = F.filter(c, lambda d: (F.abs(d["n"]) == 1) & (d["y"] == F.xxhash64(d["x"])))
        once = F.array_distinct(F.transform(pure, lambda d: F.struct(d["n"].alias("n"), d["x"].alias("x"), d["y"].alias("y"))))
        return F.transform(once, lambda d: F.struct(
            d["n"].alias("n"), d["x"].alias("x"), d["y"].alias("y"), _cells_of(d["x"], salt).alias("at")))

    def without(c: Column, out: Column) -> Column:
        def less(acc: Column, d: Column) -> Column:
            return F.struct(acc["p"].alias("p"), (acc["n"] - d["n"]).alias("n"), acc["x"].bitwiseXOR(d["x"]).alias("x"), acc["y"].bitwiseXOR(d["y"]).alias("y"))

        left = F.transform(c, lambda cell: F.aggregate(F.filter(out, lambda d: F.array_contains(d["at"], cell["p"])), cell, less))
        return F.filter(left, lambda d: (d["n"] != 0) | (d["x"] != 0))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(alone(s["c"]), lambda out: F.struct(
            F.when(F.size(out) == 0, s["c"]).otherwise(without(s["c"], out)).alias("c"),
            (s["n"] + F.size(out)).alias("n"), (F.size(out) == 0).alias("done"))))

    start = F.struct(cells.alias("c"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(CELLS)), start, step), lambda s: F.when(F.size(s["c"]) == 0, s["n"]))


def _groups(a: str, b: str, more: int) -> Column:
    """Groups of cells, a power of two, for the digests of two columns."""
    need = F.greatest(F.lit(1.0), (F.size(a) + F.size(b)) / LOAD)
    return F.pow(F.lit(2.0), F.ceil(F.log2(need))).cast("long") * more


def _dealt(keys: DataFrame) -> DataFrame:
    """Rows by id in as many partitions as the session shuffles to: the arrays
    are small and the work on them is not, so they aren't coalesced by size."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def differences(keys: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """(id, arrays of digests) → (id, one column a side): how many digests the
    two arrays of a side don't share, recovered by peeling the difference of
    their sketches.  Ids whose peeling fails go through again with twice the
    groups and other cells; the others are done.  Ids of which every side cancels
    have no row."""
    done: list[DataFrame] = []
    todo, more = keys, 1
    while True:
        parts = [F.struct(F.lit(i).alias("side"), _groups(a, b, more).alias("groups"), F.col(c).alias("digests"), F.lit(sign).alias("sign"))
                 for i, (a, b) in enumerate(sides.values()) for c, sign in ((a, 1), (b, -1))]
        rows = _dealt(todo).select("id", F.explode(F.array(*parts)).alias("s")).select("id", "s.*")
        groups = cells(rows, more).groupBy("id", "side", "g").agg(F.collect_list(F.struct("p", "n", "x", "y")).alias("c")) \
                            .select("id", "side", peeled(F.col("c"), more).alias("d"))
        sums = [F.sum(F.when(F.col("side") == i, F.col("d"))).cast("int").alias(k) for i, k in enumerate(sides)]
        found = stored(groups.groupBy("id").agg(*sums, F.max(F.col("d").isNull()).alias("failed")), "peeled")
        done.append(found.where("not failed").select("id", *[F.coalesce(k, F.lit(0)).alias(k) for k in sides]))
        failed = found.where("failed").select("id")
        if failed.isEmpty():
            break
        todo, more = todo.join(failed, "id", "left_semi"), more * 2
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out


def sketches(keys: DataFrame, columns: list[str]) -> DataFrame:
    """(id, arrays of digests) → (id, one string a column): the sketch of the
    array in one group of cells, as Base64 of the numbers, counts, digests and
    checks of the cells that are not zero."""
    parts = [F.struct(F.lit(i).alias("side"), F.lit(1).cast("long").alias("groups"), F.col(c).alias("digests"), F.lit(1).alias("sign"))
             for i, c in enumerate(columns)]
    rows = _dealt(keys).select("id", F.explode(F.array(*parts)).alias("s")).select("id", "s.*")
    def drawn(cells: Column) -> Column:
        return F.translate(F.base64(F.unhex(F.array_join(F.transform(F.array_sort(cells), lambda c: F.concat(
            F.lpad(F.hex(c["p"]), 2, "0"), F.lpad(F.hex(F.pmod(c["n"], F.lit(1 << 24))), 6, "0"),
            F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["y"]), 16, "0"))), ""))), "\r\n", "")

    held = cells(rows).groupBy("id").agg(*[
        F.collect_list(F.when(F.col("side") == i, F.struct("p", "n", "x", "y"))).alias(c) for i, c in enumerate(columns)])
    return held.select("id", *[drawn(F.col(c)).alias(c) for c in columns])


def with_next_text(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text) → also next_text, that of the next document in descending
    doc_id (null ids last; after the last, the first).

    The texts move once, to the range of ids that holds them; the bounds of the
    ranges are quantiles.  Where a range ends, the next text is the first of the
    range below, of which there are ``ranges`` at most."""
    bounds = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds or []))]).cast("array<bigint>")
    placed = docs.withColumn("_r", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda b: b <= F.col("doc_id")))))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    w = Window.partitionBy("_r").orderBy(*order)
    heads = placed.groupBy("_r").agg(F.max("doc_id").alias("_m"))
    head = F.max_by("text", F.xxhash64("text")).alias("_first")
    firsts = placed.join(heads, "_r").where(F.col("doc_id").eqNullSafe(F.col("_m"))).groupBy("_r").agg(head)
    turn = Window.orderBy(F.col("_r").desc())
    firsts = stored(firsts, "heads")
    below = firsts.select("_r", F.coalesce(F.lead("_first").over(turn), F.first("_first").over(turn)).alias("_below"))
    inside = placed.withColumns({"_next": F.lead("text").over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    return inside.join(below, "_r").select("doc_id", "text", F.when(F.col("_last"), F.col("_below")).otherwise(F.col("_next")).alias("next_text"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last third (of code points, rounded down) replaced
    by as many from the start of the next document in descending id, fewer if
    that is shorter.  Null texts count as empty, which is one empty paragraph;
    null ids come last, repeated ids in the order of their texts' hashes; a
    single document is its own next one; an empty table gives no rows; other
    columns are not read."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    texts = with_next_text(plain, ranges).withColumn("edited", edited)
    keys = stored(texts.select(
        F.monotonically_increasing_id().alias("id"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("a"), paragraph_digests(F.col("edited")).alias("e"),
        paragraph_digests(F.col("next_text")).alias("n")), "digests")
    near = differences(keys, {"near_edited": ("a", "e"), "near_next": ("a", "n")})
    drawn = sketches(keys, ["a", "e"]).select("id", F.col("a").alias("fingerprint"), F.col("e").alias("edited_fingerprint"))
    sizes = keys.select("id", "doc_id", "n_chars", "edited_sha256", *[F.size(c).alias(c) for c in ("a", "e", "n")])

    def like(side: str, other: str) -> Column:
        total, d = F.col("a") + F.col(other), F.coalesce(side, F.lit(0))
        return ((total - d) / (total + d)).alias(side)

    return sizes.join(near, "id", "left").join(drawn, "id").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("near_edited", "e"), like("near_next", "n"))
