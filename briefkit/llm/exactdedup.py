"""Exact duplicates by two-pass Bloom filtering.

The first pass notes, for every text's hash, which bits of a Bloom filter one
row set and which a second row set again; the second pass tests each row
against the bits set again.  Only rows that pass, possibly repeated, are
grouped over the network; every other row is alone and goes straight through.
A false positive costs a shuffled row and never changes a result.

The filter has ``BITS_PER_ROW`` bits a row and ``MAX_BITS`` bits at most, so
what is broadcast has a fixed bound (32 MB) at any input size; beyond it more
rows pass the test and are grouped, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANK, aside, prepare, stored

BITS_PER_ROW, MIN_BITS, MAX_BITS = 16, 1 << 16, 1 << 28
#: Bits of one segment of the filter, the unit that is merged.
SEGMENT = 1 << 16
#: Hashes a task holds before it sorts them into the filter.
HELD = 1 << 20


def normal(text: str = "text") -> Column:
    """A text without blanks, the empty text for null."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANK, "")


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(normal(text), 256)


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's bit in either half of the filter."""
    h, half = h.view(np.uint64), np.uint64(bits // 2)
    return h % half, (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) % half + half


def _segments(once: np.ndarray, twice: np.ndarray) -> Iterator[pd.DataFrame]:
    step = SEGMENT // 8
    for s in range(0, len(once), step):
        if once[s:s + step].any():
            yield pd.DataFrame({"seg": [s // step], "once": [once[s:s + step].tobytes()], "twice": [twice[s:s + step].tobytes()]})


def _note(h: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    """Set the hashes' bits: in ``twice`` those that were set before."""
    for pos in _positions(h, len(once) * 8):
        pos = np.sort(pos.astype(np.uint32))  # MAX_BITS fit
        same = pos[1:] == pos[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        more = np.zeros(len(pos), bool)
        more[1:] = same
        bit = np.left_shift(1, pos[first] & 7).astype(np.uint8)
        again = np.where(np.logical_or.reduceat(more, first), bit, 0).astype(np.uint8)
        at = pos[first] >> 3
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        at, bit, again = at[start], np.bitwise_or.reduceat(bit, start), np.bitwise_or.reduceat(again, start)
        twice[at] |= again | (once[at] & bit)
        once[at] |= bit


def repeated_bits(hashes: DataFrame, bits: int, every: bool = False) -> np.ndarray:
    """First pass over column h: the bits that two rows or more have set; with
    ``every`` those that any row has set."""
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        held, size = [], 0
        for pdf in batches:
            held.append(pdf["h"].to_numpy(np.int64))
            size += len(held[-1])
            if size > HELD:
                _note(np.concatenate(held), once, twice)
                held, size = [], 0
        if size:
            _note(np.concatenate(held), once, twice)
        yield from _segments(once, once if every else twice)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for seg, a, b in zip(pdf["seg"], pdf["once"], pdf["twice"]):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if seg in met:
                    once, twice = met[seg]
                    twice |= b | (once & a)
                    once |= a
                else:
                    met[seg] = [a.copy(), b.copy()]
        for seg, (_, twice) in met.items():
            if twice.any():
                yield pd.DataFrame({"seg": [seg], "twice": [twice.tobytes()]})

    parts = hashes.select("h").mapInPandas(local, "seg int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for seg, twice in parts.repartition("seg").mapInPandas(merged, "seg int, twice binary").collect():
        out[seg * SEGMENT // 8:(seg + 1) * SEGMENT // 8] = np.frombuffer(twice, np.uint8)
    return out


def set_in(twice: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set in a filter."""
    found = np.ones(len(h), bool)
    for pos in _positions(h, len(twice) * 8):
        found &= (twice[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def filter_size(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_ROW * rows - 1).bit_length())) if rows else MIN_BITS


def tester(df: DataFrame, twice: np.ndarray):
    """Second pass: column function of h, whether the hash may be repeated."""
    shared = df.sparkSession.sparkContext.broadcast(twice)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(set_in(shared.value, h.to_numpy(np.int64)))

    return test


def _decide(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, object]:
    prepare(docs.sparkSession)
    rows = stored(docs.select(docs[doc_id].alias("doc_id"), digest(text).alias("text_sha256"),
                              F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"))
                  .withColumn("h", F.xxhash64("text_sha256")), "hashes")
    maybe = tester(rows, repeated_bits(rows, filter_size(rows.count())))
    rows = stored(rows.withColumn("maybe", maybe("h")), "tested")
    alone = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                           F.lit(True).alias("kept"), "text_sha256")
    some = rows.where("maybe")
    best = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
    groups = stored(some.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    met = some.join(groups, "text_sha256").select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size",
        ((F.col("best.col1") == -F.col("n")) & F.col("doc_id").eqNullSafe(F.col("best.d"))).alias("kept"), "text_sha256")
    return alone.unionByName(met), met, maybe


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without their blanks; of equal texts the row
    with the most code points stays, then the smallest id.  Null texts count as
    empty; null ids come last, and keep_id is null only if no row with as many
    code points has an id; rows that repeat id and text each count in
    group_size and share kept; an empty table gives no rows; other columns are
    not read."""
    return _decide(docs, doc_id, text)[0]


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents with one row per text, with the columns of ``docs``: the
    row that ``exact_duplicates`` keeps, one only where rows repeat it.  The
    texts of documents that the filter finds alone are not shuffled."""
    docs, back = aside(docs)
    _, grouped, maybe = _decide(docs, "doc_id", "text")
    kept = grouped.where("kept").select(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id"))
    tested = docs.withColumn("_sha256", digest()).withColumn("_maybe", maybe(F.xxhash64("_sha256")))
    some = tested.where("_maybe").withColumn("_n", F.coalesce(F.length("text"), F.lit(0)))
    kept = stored(kept.distinct(), "kept")
    won = some.join(kept.hint("merge"), (some["_sha256"] == kept["_sha"]) & some["doc_id"].eqNullSafe(kept["_id"]))
    one = won.groupBy("_sha256").agg(F.max_by(F.struct(*docs.columns), "_n").alias("_row")).select("_row.*")
    return back(tested.where("not _maybe").select(*docs.columns).unionByName(one))
