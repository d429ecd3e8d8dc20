"""Repeated passages by paragraph MinHash banding.

A paragraph is a line of a document.  Its set of five-word shingles has a
MinHash signature whose bands are wide enough for the similarity wanted and so
many that a pair at that similarity shares one with ``RECALL``.  A first pass
notes in a Bloom filter of bounded size which bands two paragraphs or more may
share; in a second only paragraphs with such a band leave their task, one of
each text.  Those that share a band are compared by the Jaccard similarity of
their shingle sets, in tiles of bounded size that give back a spanning forest
of the similar pairs, and components of these links are the classes.

A paragraph repeats if one of its class comes before it (by document, then
line).  Runs of such paragraphs with ``WORDS`` words or more are the passages
that are removed: a short line that others also have is no passage by itself.

Passages that are no whole lines are found by their words.  Every run of
``WORDS`` words has an anchor, the least hash of the shorter runs (of half the
words) in it, so anchors move with the text and equal runs have equal ones.
Anchors go through the same Bloom filter; the runs whose anchor may be repeated
leave their task as hashes, those in a row with one anchor as a cell.  Inside a
passage cells are equal whole; only where an anchor has unlike cells, at the
ends of passages, are these compared run by run.  A run that another place has
before it is part of a passage.  The union of such runs is exact, up to 64-bit
hashes: each passage is as long as what is repeated, wherever it stands.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .exactdedup import filter_size, repeated_bits, set_in, tester
from .shared import prepare, stored, text_bytes

SHINGLE, SIMILAR, WORDS = 5, 0.8, 50
RECALL = 0.995
#: Paragraphs of a tile's side; a task compares two sides at most.
CHUNK = 1024
#: Runs of words in one cell.
RUNS = 4096
#: Base of the runs' hashes and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Word hashes that a task remembers.
REMEMBERED = 300_000
U = np.uint64


def bands(similar: float = SIMILAR, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with three rows or more a band whose
    bands catch a pair at the similarity with the recall."""
    def need(rows: int) -> int:
        return math.ceil(math.log(1 - recall) / math.log(1 - similar ** rows))

    rows = min(range(3, 9), key=lambda r: need(r) * r)
    return need(rows), rows


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((31, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
        y = x >> U(shift)
        y ^= x
        y *= U(factor)
        x = y
    y = x >> U(32)
    y ^= x
    return y


class Hashes(dict):
    """Word → 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = out
        return out


def _sliding(op: np.ufunc, a: np.ndarray, size: int) -> np.ndarray:
    """``op`` over every ``size`` neighbours."""
    n = 1
    while 2 * n <= size:
        a = op(a[:-n], a[n:])
        n *= 2
    return op(a[:len(a) - (size - n)], a[size - n:])


def word_runs(h: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of documents with so many words each → starts of the runs of
    ``words`` words, their hashes and anchors, and every anchor once a place."""
    words = max(words, 1)
    short = (words + 1) // 2
    n, none = len(h), np.zeros(0, U)
    if n < words:
        return np.zeros(0, np.int64), none, none, none
    power, back = (np.cumprod(np.concatenate((np.ones(1, U), np.full(n - 1, U(b))))) for b in (BASE, INVERSE))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(h * power)))
    grams, whole = (_mix((sums[k:] - sums[:-k]) * back[:n - k + 1]) for k in (short, words))
    many = words - short + 1
    least = _sliding(np.minimum, grams, many)
    inside = np.arange(words, n + 1) <= np.repeat(np.cumsum(sizes), sizes)[:n - words + 1]
    pad = np.zeros(many - 1, U)
    chosen = _sliding(np.maximum, np.concatenate((pad, np.where(inside, least, U(0)), pad)), many) == grams
    at = np.flatnonzero(inside)
    return at, whole[at], least[at], grams[chosen]


class Lines:
    """The paragraphs with a word of a batch of documents: ``doc`` (place in
    the batch), ``line``, ``nth`` (number among the document's paragraphs),
    ``words``, ``shingles`` (hashes, flat) with ``starts``; ``hashes`` of all
    words, ``total`` words of each document."""

    def __init__(self, texts: list[bytes], known: Hashes, shingle: int = SHINGLE) -> None:
        doc, line, nth, sizes, hashes = [], [], [], [], []
        self.lines = []
        for d, t in enumerate(texts):
            rows = t.lower().split(b"\n")
            self.lines.append(len(rows))
            n = 0
            for k, row in enumerate(rows):
                if words := row.split():
                    doc.append(d)
                    line.append(k)
                    nth.append(n)
                    n += 1
                    sizes.append(len(words))
                    hashes += map(known.__getitem__, words)
        self.doc, self.line, self.words = np.array(doc, np.int64), np.array(line, np.int64), np.array(sizes, np.int64)
        self.nth = np.array(nth, np.int64)
        h = self.hashes = np.array(hashes, U)
        self.total = np.bincount(self.doc, self.words, len(texts)).astype(np.int64)
        ends = np.cumsum(self.words)
        first = ends - self.words
        count = np.maximum(self.words - shingle + 1, 1)
        self.starts = np.cumsum(count) - count
        at = np.repeat(first - self.starts, count) + np.arange(int(count.sum()))
        own_end = np.repeat(ends, count)
        x = np.zeros(len(at), U)
        h = np.append(h, U(0))
        for j in range(shingle):  # a line of fewer words is one shingle of them all
            inside = at + j < own_end
            x = np.where(inside, _mix(x * U(0x100000001B3) + h[np.minimum(at + j, len(h) - 1)] + U(j + 1)), x)
        self.shingles, self.count = x, count

    def bands(self, number: int, rows: int) -> np.ndarray:
        """Band hashes, a row a paragraph."""
        out = np.zeros((len(self.doc), number), U)
        if not len(self.doc):
            return out
        for b in range(number):
            for r in range(rows):
                seed = _mix(np.array([b * rows + r + 1], U))
                least = np.minimum.reduceat(_mix(self.shingles ^ seed), self.starts)
                out[:, b] = _mix(out[:, b] * U(31) + least + U(b))
        return out

    def texts(self) -> np.ndarray:
        """Hash of each paragraph's words in their order."""
        place = np.arange(len(self.shingles)) - np.repeat(self.starts, self.count)
        mixed = _mix(self.shingles + _mix(place.astype(U) + U(7)))
        return _mix(np.add.reduceat(mixed, self.starts) + self.words.astype(U)) if len(self.doc) else np.zeros(0, U)

    def set_of(self, i: int) -> bytes:
        own = self.shingles[self.starts[i]:self.starts[i] + self.count[i]]
        return np.unique((own >> U(32)).astype(np.uint32)).tobytes()


def similar_links(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets with that Jaccard similarity."""
    links, left = [], np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            fit = (size[left] >= similar * size[x]) & (size[left] * similar <= size[x])
            some = left[fit]
            if not len(some):
                continue
            flat = np.concatenate([sets[i] for i in some])
            starts = np.cumsum(size[some]) - size[some]
            at = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
            both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), starts)
            hit = some[both >= similar * (size[some] + size[x] - both) - 1e-9]
            if len(hit):
                links += [(x, i) for i in hit]
                queue += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return links


def _tiles(similar: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by tile → links between paragraph texts."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["v", "i", "j"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if not len(cut):
                rest = pdf
                continue
            yield found(pdf.iloc[:cut[-1]], cut)
            rest = pdf.iloc[cut[-1]:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield found(rest, np.array([len(rest)]))

    def found(pdf: pd.DataFrame, cut: np.ndarray) -> pd.DataFrame:
        h, sets = pdf["h"].to_numpy(np.int64), [np.frombuffer(s, np.uint32) for s in pdf["set"]]
        out: set[tuple[int, int]] = set()
        for a, b in zip([0, *cut[:-1].tolist()], cut.tolist()):
            own = np.unique(h[a:b], return_index=True)[1] + a
            for x, y in similar_links([sets[i] for i in own], similar):
                out.add((int(h[own[x]]), int(h[own[y]])))
        return pd.DataFrame(list(out), columns=["a", "b"], dtype="int64")

    return run


ROWS = "row long, doc_id long, size long, line int, nth int, words int, h long, bands array<long>, set binary"


def _candidates(data: DataFrame, number: int, rows: int, shingle: int, run: int) -> DataFrame:
    """Every document (a row with line -1, the text's hash in ``h``), its paragraphs that may repeat, and
    its cells that may (rows with line -2: the place of the first word in
    ``words``, the anchor in ``h``, the hashes of the runs in ``bands``)."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for pdf in batches:
            lines = Lines(pdf["data"].tolist(), known, shingle)
            anchors = word_runs(lines.hashes, lines.total, run)[3]
            yield pd.DataFrame({"h": np.concatenate((lines.bands(number, rows).ravel(), anchors)).view(np.int64)})

    breaks = F.length("data") - F.octet_length(F.replace(F.col("data").cast("string"), F.lit("\n"), F.lit(""))) + 1
    total, size = (x or 0 for x in data.agg(F.sum(breaks), F.sum(F.length("data"))).first())
    places = 4 * size // (6 * (run + 4))  # an anchor in about a quarter of a run's words, words of some six bytes
    twice = repeated_bits(data.select("data").mapInPandas(hashed, "h long"), filter_size(total * number + places))
    shared = data.sparkSession.sparkContext.broadcast(twice)

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, at = Hashes(), TaskContext.get().partitionId() << 33  # a task's rows have numbers of their own
        for pdf in batches:
            lines = Lines(pdf["data"].tolist(), known, shingle)
            ids = pdf["doc_id"].astype("Int64")
            row = np.arange(at, at + len(pdf))
            at += len(pdf)
            yield pd.DataFrame({"row": row, "doc_id": ids, "size": lines.lines, "line": -1, "nth": 0, "words": 0, "h": pdf["text_h"], "bands": None, "set": None})
            found = lines.bands(number, rows)
            hit = set_in(shared.value, found.ravel().view(np.int64)).reshape(found.shape)
            own, texts = np.flatnonzero(hit.any(axis=1)), lines.texts().view(np.int64)
            for s in range(0, len(own), 2000):
                k = own[s:s + 2000]
                yield pd.DataFrame({"row": row[lines.doc[k]], "doc_id": ids.iloc[lines.doc[k]].to_numpy(), "size": 0, "line": lines.line[k], "nth": lines.nth[k], "words": lines.words[k],
                                    "h": texts[k], "bands": [found[i][hit[i]].view(np.int64) for i in k], "set": [lines.set_of(i) for i in k]})
            at_word, whole, least, _ = word_runs(lines.hashes, lines.total, run)
            own = np.flatnonzero(set_in(shared.value, least.view(np.int64)))
            if not len(own):
                continue
            at_word, whole, least = at_word[own], whole[own].view(np.int64), least[own].view(np.int64)
            begin = np.cumsum(lines.total) - lines.total
            of = np.searchsorted(begin, at_word, "right") - 1
            new = np.concatenate(([True], (np.diff(at_word) != 1) | (np.diff(of) != 0) | (least[1:] != least[:-1])))
            nth = np.arange(len(own))
            new |= (nth - np.maximum.accumulate(np.where(new, nth, 0))) % RUNS == 0
            cuts = np.append(np.flatnonzero(new), len(own))
            for s in range(0, len(cuts) - 1, 5000):
                k = cuts[s:s + 5001]
                d = of[k[:-1]]
                yield pd.DataFrame({"row": row[d], "doc_id": ids.iloc[d].to_numpy(), "size": 0, "line": -2, "nth": 0, "words": at_word[k[:-1]] - begin[d],
                                    "h": least[k[:-1]], "bands": [whole[a:b] for a, b in zip(k, k[1:])], "set": None})

    return stored(data.mapInPandas(picked, ROWS), "paragraphs")


def _shared(pairs: DataFrame) -> DataFrame:
    """(h, v) → (v, n): the bands of two texts or more.  Similar texts share
    many: of bands with the same texts (up to 64-bit hashes) one stays."""
    met = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"))
    return met.where("n > 1").groupBy("n", "x").agg(F.min("v").alias("v")).select("v", "n")


def _classes(marked: DataFrame, similar: float, chunk: int) -> DataFrame:
    """(h, label) of paragraph texts that are similar to another text."""
    texts = stored(marked.where("line >= 0").groupBy("h").agg(F.first("bands").alias("bands"), F.first("set").alias("set")), "texts")
    pairs = texts.select("h", F.explode("bands").alias("v"))
    many = stored(_shared(pairs), "bands")
    m = F.ceil(F.col("n") / chunk)
    t = F.pmod(F.xxhash64("h"), m)
    met = pairs.join(many, "v").select("v", "h", t.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("u"))
    met = met.select("v", "h", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"))
    met = stored(met, "met")
    # sets of texts that share no band after all stay where they are, but for false positives of a filter
    asked = tester(texts, repeated_bits(met.select("h"), filter_size(met.count()), every=True))
    tiles = met.join(texts.select("h", "set").where(asked("h")), "h").repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    return components(tiles.select("v", "i", "j", "h", "set").mapInPandas(_tiles(similar), "a long, b long"))


def _word_passages(marked: DataFrame, words: int) -> DataFrame:
    """By row of documents that have any: passages, passage_words, passage_docs."""
    cells = marked.where("line = -2").select("row", "doc_id", F.col("words").alias("i"), F.col("h").alias("v"), "bands",
                                             F.size("bands").alias("m"), F.xxhash64("bands").alias("c"))
    narrow = cells.select("row", "doc_id", "i", "v", "c", "m", (F.size(F.array_distinct("bands")) < F.col("m")).alias("odd"))
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "i")
    kinds = stored(narrow.groupBy("v", "c").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n"), F.max("odd").alias("odd"))
                   .select("v", "c", "n", "odd", F.col("f.doc_id").alias("from"), F.col("f.row").alias("first_row"), F.col("f.i").alias("first_i")), "cells")
    # the first cell of each kind, run by run, where an anchor has unlike ones or a cell repeats a run
    mixed = kinds.groupBy("v").agg(F.count(F.lit(1)).alias("k"), F.max("odd").alias("o")).where("k > 1 or o").select("v")
    heads = stored(kinds.join(mixed, "v").select(F.col("first_row").alias("row"), F.col("first_i").alias("i")), "heads")
    # the hashes of other cells stay where they are, but for false positives of a filter
    key = F.xxhash64("row", "i")
    chosen = repeated_bits(heads.select(key.alias("h")), filter_size(heads.count()), every=True)
    runs = cells.select("row", "doc_id", "i", "bands").where(tester(cells, chosen)(key)).join(heads, ["row", "i"]) \
        .select("row", "doc_id", F.col("i").alias("at"), F.posexplode("bands").alias("k", "w"))
    runs = stored(runs.select("row", "doc_id", "at", (F.col("at") + F.col("k")).alias("i"), "w"), "word_runs")
    firsts = stored(runs.groupBy("w").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select("w", F.col("f.doc_id").alias("from"), F.col("f.row").alias("first_row"), F.col("f.i").alias("first_i")), "first_runs")
    seen = stored(runs.join(firsts, "w").select("row", "doc_id", "at", "i", "from", "first_row", "first_i"), "seen_runs")
    # a head's runs stand first where it does, but for those seen
    sources = seen.groupBy(F.col("row").alias("first_row"), F.col("at").alias("first_i")).agg(F.collect_set("from").alias("froms"), F.count(F.lit(1)).alias("met"))
    again = seen.where("row != first_row or i != first_i").select("row", F.col("i").alias("a"), F.col("i").alias("b"), F.array("from").alias("froms"))
    # the other cells of a kind stand before as a whole
    others = narrow.join(kinds.where("n > 1").drop("odd"), ["v", "c"]).where("row != first_row or i != first_i")
    froms = F.when(F.col("met") == F.col("m"), F.col("froms")).otherwise(F.array_append(F.coalesce("froms", F.array().cast("array<bigint>")), F.col("from")))
    others = others.join(sources, ["first_row", "first_i"], "left").select(
        "row", F.col("i").alias("a"), (F.col("i") + F.col("m") - 1).alias("b"), froms.alias("froms"))
    # within a document, as the runs of lines
    w = Window.partitionBy("row").orderBy("a")
    new = F.coalesce(F.col("a") > F.lag("b").over(w) + words, F.lit(True))
    met = again.unionAll(others).withColumn("run", F.sum(new.cast("int")).over(w)).groupBy("row", "run").agg(
        F.min("a").alias("first"), (F.max("b") + words - 1).alias("last"),
        F.array_compact(F.array_distinct(F.flatten(F.collect_set("froms")))).alias("froms"))
    return stored(met.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("passages"), F.sum(F.col("last") - F.col("first") + 1).alias("passage_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("froms")))).alias("passage_docs")), "word_passages")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR,
             words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, lines, repeated_lines, removed_lines,
    removed_words, spans (array of struct first, last: the runs of lines,
    counted from 0, that are removed), first_docs (sorted ids of the documents
    that have the removed lines first), component_id (the smallest id among
    documents that share removed passages with it, its own included), passages
    (array of struct first, last: the longest runs of words, counted from 0
    over the whole document, all of whose runs of ``words`` words stand before,
    in an earlier document or in this one, in any case and with any blanks),
    passage_words, passage_docs (sorted ids of the documents that have these
    runs first).  Removed lines are whole ones, alike or equal; passages are
    equal words within lines or across them.  text_h is a hash of the text.

    Null texts count as empty: one line without words.  Lines without words are
    part of a run but neither begin nor end one.  Null ids come last in the
    order of documents; rows that repeat an id are documents like others, in
    the order of the table's partitions; an empty table gives no rows; other
    columns are not read.  A very long text takes some tens of bytes a word in
    one task."""
    prepare(docs.sparkSession)
    number, rows = bands(similar)
    data = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_bytes(docs[text]).alias("data")).withColumn("text_h", F.xxhash64("data"))
    words = max(words, 1)
    marked = _candidates(data, number, rows, shingle, words)
    labels = stored(_classes(marked, similar, chunk), "classes")
    some = marked.where("line >= 0").select("row", "doc_id", "line", "nth", "words", "h")
    named = some.join(labels, F.col("h") == F.col("node"), "left").select("row", "doc_id", "line", "nth", "words", F.coalesce("label", "h").alias("c"))
    named = stored(named, "named")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "line")
    firsts = stored(named.groupBy("c").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    again = named.join(firsts, "c").where((F.col("row") != F.col("f.row")) | (F.col("line") != F.col("f.line"))) \
        .select("row", "line", "nth", "words", F.col("f.doc_id").alias("from"))
    # runs within a document, whose lines are at most those of one text
    w = Window.partitionBy("row").orderBy("line")
    new = (F.col("nth") != F.lag("nth").over(w) + 1) | F.lag("nth").over(w).isNull()
    runs = again.withColumn("run", F.sum(new.cast("int")).over(w)).groupBy("row", "run").agg(
        F.min("line").alias("first"), F.max("line").alias("last"), F.count(F.lit(1)).alias("k"), F.sum("words").alias("words"),
        F.collect_set("from").alias("froms"))
    long = F.col("words") >= words
    out = stored(runs.groupBy("row").agg(
        F.sum("k").alias("repeated_lines"), F.sum(F.when(long, F.col("last") - F.col("first") + 1).otherwise(0)).alias("removed_lines"),
        F.sum(F.when(long, F.col("words")).otherwise(0)).alias("removed_words"),
        F.array_sort(F.collect_list(F.when(long, F.struct("first", "last")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(long, F.col("froms")))))).alias("first_docs")), "runs")
    each = marked.where("line = -1").select("row", "doc_id", F.col("size").alias("lines"), F.col("h").alias("text_h")).join(out, "row", "left") \
        .join(_word_passages(marked, words), "row", "left")
    each = stored(each, "each")
    links = each.select(F.col("doc_id").alias("a"), F.explode("first_docs").alias("b")) \
        .unionAll(each.select("doc_id", F.explode("passage_docs")))
    joined = stored(components(links), "documents")
    spans = F.array().cast("array<struct<first:int,last:int>>")
    return each.join(joined, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "lines", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("repeated_lines", "removed_lines", "removed_words")],
        F.coalesce("spans", spans).alias("spans"), F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
        F.coalesce("label", "doc_id").alias("component_id"), F.coalesce("passages", spans).alias("passages"),
        F.coalesce("passage_words", F.lit(0)).cast("long").alias("passage_words"),
        F.coalesce("passage_docs", F.array().cast("array<bigint>")).alias("passage_docs"), "text_h")


def without_passages(docs: DataFrame, found: DataFrame | None = None, words: bool = False) -> DataFrame:
    """The documents without the passages that others have before them, with
    the columns of ``docs``; a document's other lines stay.  With ``words`` the
    words of passages within lines or across them go too, each with the blanks
    after it but for line ends.  Rows that repeat an id are told apart by their
    text, and where they repeat that too by their number, as they are alike."""
    found = repeated(docs) if found is None else found
    copy = Window.partitionBy("_id", "_h").orderBy("_gone")
    gone = (F.col("removed_lines") + (F.col("passage_words") if words else F.lit(0))).alias("_gone")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_h").alias("_h"), F.col("spans").alias("_spans"), F.col("passages").alias("_passages"), gone)
    found = stored(found.withColumn("_copy", F.row_number().over(copy)).where("_gone > 0"), "cut")
    alike = Window.partitionBy("doc_id", "_text_h").orderBy(F.lit(0))
    some = docs.withColumn("_text_h", F.xxhash64(text_bytes("text")))
    touched = some.join(found.select("_id", "_h").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_h") == F.col("_h")), "left_semi")
    others = some.join(found.select("_id", "_h").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_h") == F.col("_h")), "left_anti")
    touched = touched.withColumn("_nth", F.row_number().over(alike))
    rows = F.filter(F.split("text", "\n", -1), lambda x, k: ~F.exists("_spans", lambda s: (s["first"] <= k) & (k <= s["last"])))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series, passages: pd.Series) -> pd.Series:
        return pd.Series([_rest(*x) for x in zip(texts, spans, passages)], dtype=object)

    left = rest("text", "_spans", "_passages") if words else F.array_join(rows, "\n")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_h") == F.col("_h")) & (F.col("_nth") == F.col("_copy"))
    cut = touched.join(found, same, "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    return cut.select(*docs.columns).unionByName(others.select(*docs.columns))


def _rest(text: str | None, spans, passages) -> str | None:
    """A text without lines and without words."""
    if text is None or spans is None:
        return text
    gone = {k for s in spans for k in range(s["first"], s["last"] + 1)}
    cut = {k for s in passages for k in range(s["first"], s["last"] + 1)}
    out, n = [], 0
    for k, line in enumerate(text.split("\n")):
        parts = re.split("([^ \t\x0b\x0c\r]+)", line)  # blanks, word, blanks, ...
        kept = parts[0] + "".join(a + b for j, (a, b) in enumerate(zip(parts[1::2], parts[2::2])) if n + j not in cut)
        n += len(parts) // 2
        if k not in gone and (kept or not line):  # a line that was nothing but the passage goes with it
            out.append(kept)
    return "\n".join(out)
