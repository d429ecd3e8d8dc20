"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has a bit set where over half of its shingles' hashes
have it.  Two fingerprints that differ in at most ``d`` bits, cut into
``d + 2`` blocks, agree in at least two whole blocks; so each distinct
fingerprint is keyed by every pair of its blocks and only fingerprints that
share a key are compared, by their exact Hamming distance.

Only distinct fingerprints are compared: exact copies, be they a third of all
rows, are one of them.  A key shared by many fingerprints is cut into chunks
whose pairs go to different tasks; a task holds two chunks at most and gives
back a spanning forest of its close pairs, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import aside, prepare, stored, text_bytes

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints of one chunk of a key; a task compares two chunks at most.
CHUNK = 2048
#: Shingle hashes whose bits are counted at once.
BLOCK = 1 << 16


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text's UTF-8 bytes, as a signed 64-bit integer.

    Bytes are lower-cased in A-Z only and split at the six ASCII blanks; a text
    of fewer than ``shingle`` words is one shingle, one without words is 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> Column:
    """Column of a text's fingerprint (long); null and blank texts give 0."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, shingle) for x in texts], dtype="int64")

    return of(text_bytes(docs[text]))


def _keys(max_bits: int) -> Column:
    """Array of (c, v): pair of blocks c, fingerprint masked to those blocks."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(n)]
    out = []
    for c, pair in enumerate(combinations(range(n), 2)):
        mask = sum(masks[i] for i in pair)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*out)


def _near(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of ``values`` within ``max_bits``: each
    value found is compared with those not found so far, and with no others."""
    links, left = [], values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= max_bits
            if hit.any():
                links += [(int(y), int(x)) for y in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
    return links


def _tiles(max_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by tile → links of each tile; a tile may span batches."""
        rest = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["c", "v", "i", "j"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if not len(cut):
                rest = pdf
                continue
            yield from found(pdf["fp"].to_numpy()[:cut[-1]].view(np.uint64), cut[:-1])
            rest = pdf.iloc[cut[-1]:]
        if rest is not None and len(rest):
            yield from found(rest["fp"].to_numpy().view(np.uint64), np.zeros(0, np.int64))

    def found(fp: np.ndarray, cut: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.concatenate(([0], cut))
        sizes = np.diff(np.concatenate((starts, [len(fp)])))
        out = []
        two = starts[sizes == 2]  # the most frequent size, all at once
        close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
        out.append(np.stack([fp[two][close], fp[two + 1][close]], axis=1))
        for a, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if links := _near(np.unique(fp[a:a + n]), max_bits):
                out.append(np.array(links, np.uint64))
        links = np.unique(np.concatenate(out), axis=0).view(np.int64)
        yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return run


def close_links(fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (fp) → links (a, b) that connect exactly those
    fingerprints which chains of pairs within ``max_bits`` connect."""
    bands = fps.select("fp", F.explode(_keys(max_bits)).alias("k")).select("fp", "k.c", "k.v")
    many = stored(bands.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    # Chunk t of a key with m chunks meets every chunk: tiles (min, max) of (t, u).
    m = F.ceil(F.col("n") / chunk)
    t = F.pmod(F.xxhash64(F.col("fp")), m)
    met = bands.join(many, ["c", "v"]).select("c", "v", "fp", t.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("u"))
    tiles = met.select("c", "v", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "fp")
    return tiles.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j") \
                .mapInPandas(_tiles(max_bits), "a long, b long")


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int) -> DataFrame:
    """A row a document: doc_id, text_h (hash of the text), fp, label (of its
    component), component_id."""
    prepare(docs.sparkSession)
    fps = stored(docs.select(docs[doc_id].cast("long").alias("doc_id"), fingerprints(docs, text, shingle).alias("fp"), F.xxhash64(docs[text]).alias("text_h")), "fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    labels = components(close_links(distinct.select("fp"), max_bits))
    label = F.coalesce(F.col("label"), F.col("fp")).alias("label")
    named = stored(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "rep", label), "named")
    least = stored(named.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    named = stored(named.join(least, "label").select("fp", "label", "component_id"), "component")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id among the documents that chains of links
    reach, the document's own included.  Null and blank texts have the
    fingerprint zero and are linked like any other; rows that repeat a
    document give a row each; null ids are kept, and never the smallest unless
    no other id is reached (then component_id is null); an empty table gives no
    rows; other columns are not read."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _grouped(docs, doc_id, text, shingle, max_bits).select("doc_id", hexed, "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without near-duplicates, with the columns of ``docs``: of
    each component the row with the smallest id stays, of several with that id
    the one whose text has the smallest hash.

    Rows are told apart by id and text, so an unlike text that shares an id
    with a copy stays.  Rows that repeat both are one: all of them stay or go.
    Documents without an id all stay."""
    docs, back = aside(docs)
    found = stored(_grouped(docs, "doc_id", "text", shingle, max_bits).where("doc_id is not null").select("doc_id", "text_h", "label"), "grouped")
    first = stored(found.groupBy("label").agg(F.min(F.struct("doc_id", "text_h")).alias("f")), "first")
    gone = found.join(first, "label").where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("text_h") != F.col("f.text_h")))
    gone = stored(gone.select(F.col("doc_id").alias("_gone"), F.col("text_h").alias("_h")).distinct(), "gone")
    own = docs.withColumn("_own", F.xxhash64("text"))
    return back(own.join(gone.hint("merge"), (F.col("doc_id") == F.col("_gone")) & (F.col("_own") == F.col("_h")), "left_anti"))
