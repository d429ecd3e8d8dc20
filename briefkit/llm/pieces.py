"""SentencePiece encoding and decoding, giant documents by a max-plus scan.

A BPE segmentation is the one sequence of pieces in which every two neighbours,
encoded together, stay the same two pieces.  So it is a path of states, and a
giant document can be cut anywhere: the state at a cut is the piece that holds
the character before it.  A chunk yields the matrix of transfers between the
states at its two cuts: minus the number of pieces that begin in the chunk,
where the text from the one piece to the other encodes with these two at its
ends, else minus infinity.  The matrices combine associatively under (max, +);
the one path that reaches the end of the document gives every cut its state,
and from the states at its cuts each chunk is encoded by itself.

No piece goes over the start of a word, so the words inside a chunk add the
same number to all transfers and only the parts at the cuts are encoded for
each state; a chunk without a word's start is encoded for each pair of states.
Texts of one chunk are encoded word by word, each word once per task.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored
from .tokencount import MARK, model_bytes, whole_tokens

#: Code points of a chunk, and of its neighbours that it sees on either side.
CHUNK, MARGIN = 65_536, 64
REMEMBERED = 300_000
NONE = -np.inf


class Pieces:
    """The library's encoder, with words remembered and parts of words."""

    def __init__(self, model: bytes) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.longest = max(len(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size()))
        if self.longest > MARGIN:
            raise ValueError("a piece of this model is longer than a chunk's margin")
        self.gap = self.sp.encode("\n")  # an own byte piece: nothing merges with it
        if any("\n" in self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())):
            raise ValueError("a piece of this model holds a line end")
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers: a small part of what lists take

    def part(self, marked: str) -> list[int]:
        """Ids of a string by itself, with no space mark put before it."""
        return self.sp.encode("\n" + marked)[len(self.gap):] if marked else []

    def spans(self, ids: list[int]) -> list[tuple[int, list[int]]]:
        """Ids by character span: (characters, ids); a character of byte
        pieces is one span."""
        out, i = [], 0
        while i < len(ids):
            if self.sp.is_byte(ids[i]):
                first = int(self.sp.id_to_piece(ids[i])[3:5], 16)
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                out.append((1, ids[i:i + n]))
                i += n
            else:
                out.append((len(self.sp.id_to_piece(ids[i])), ids[i:i + 1]))
                i += 1
        return out

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces that may hold the character before a cut: (characters before
        the cut, characters after it)."""
        if cut <= 0:
            return [(0, 0)]
        out = []
        for a in range(1, min(cut, self.longest) + 1):
            for b in range(min(len(text) - cut, self.longest - a) + 1):
                piece = text[cut - a:cut + b]
                i = self.sp.piece_to_id(piece)
                ok = self.sp.id_to_piece(i) == piece and not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))
                if ok or (a, b) == (1, 0):
                    out.append((a, b))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library gives them."""
        parts = [[x[1:] for x in re.findall(" +[^ ]*", " " + t.replace(MARK, " "))] if t else [] for t in texts]
        met = set().union(*parts)
        if len(self.known) + len(met) > REMEMBERED:
            self.known = {}
        new = [x for x in met - self.known.keys()]
        words = [x for x in new if x.strip(" ")]
        for i in range(0, len(words), 10_000):
            some = words[i:i + 10_000]
            self.known |= ((w, array("i", ids).tobytes()) for w, ids in zip(some, self.sp.encode(some, num_threads=1)))
        for x in new:
            if not x.strip(" "):  # spaces that end a text
                self.known[x] = array("i", self.part(MARK + x.replace(" ", MARK))).tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]


class Chunk:
    """Characters lo to hi of a marked text, with margins."""

    def __init__(self, pieces: Pieces, text: str, lo: int, hi: int, last: bool) -> None:
        self.p, self.text, self.lo, self.hi = pieces, text, lo, hi
        self.left = pieces.states(text, lo)
        self.right = [(a, b) for a, b in pieces.states(text, hi) if not (last and b)]
        starts = [m.start() + 1 for m in re.compile(f"[^{MARK}](?={MARK})").finditer(text, max(0, lo - 1), hi)]
        starts = [s for s in starts if lo <= s < hi] if lo else [0, *[s for s in starts if 0 < s < hi]]
        self.starts = (starts[0], starts[-1]) if starts else None

    def _head(self, s: tuple[int, int], to: int) -> list[tuple[int, list[int]]] | None:
        """Spans from state s's piece to ``to``, without that piece."""
        a, b = s
        found = self.p.spans(self.p.part(self.text[self.lo - a:to]))
        if a == 0:
            return found
        return found[1:] if found and found[0][0] == a + b else None

    def _across(self, s: tuple[int, int]) -> bool:
        """Whether a state's piece holds the chunk's last character too."""
        return s[1] >= self.hi - self.lo and self.lo > 0

    def transfer(self) -> np.ndarray:
        out = self._transfer()
        size = self.hi - self.lo
        for i, (a, b) in enumerate(self.left):
            if self._across((a, b)):
                out[i] = [0.0 if t == (a + size, b - size) else NONE for t in self.right]
        return out

    def _transfer(self) -> np.ndarray:
        out = np.full((len(self.left), len(self.right)), NONE)
        if self.starts is None:
            for i, s in enumerate(self.left):
                for j, (a, b) in enumerate(self.right):
                    found = self._head(s, self.hi + b)
                    if found and found[-1][0] == a + b:
                        out[i, j] = -sum(len(x) for _, x in found)
            return out
        first, end = self.starts
        heads = [self._head(s, first) for s in self.left]
        middle = len(self._middle())
        for j, (a, b) in enumerate(self.right):
            found = self.p.spans(self.p.part(self.text[end:self.hi + b]))
            if found and found[-1][0] == a + b:
                for i, h in enumerate(heads):
                    if h is not None:
                        out[i, j] = -sum(len(x) for _, x in h) - middle - sum(len(x) for _, x in found)
        return out

    def _middle(self) -> list[int]:
        """Ids between the first and the last start of a word, by words."""
        first, end = self.starts
        return self.p.encode([self.text[first + 1:end].replace(MARK, " ")])[0].tolist() if end - first > 1 else self.p.part(self.text[first:end])

    def ids(self, s: int, t: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, between two states."""
        _, b = self.right[t]
        if self._across(self.left[s]):
            return []
        if self.starts is None:
            return [i for _, x in self._head(self.left[s], self.hi + b) or [] for i in x]
        head = [i for _, x in self._head(self.left[s], self.starts[0]) or [] for i in x]
        return head + self._middle() + self.p.part(self.text[self.starts[1]:self.hi + b])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of transfer matrices under (max, +); associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def resolve(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """States at the cuts of every chunk, on the path to the end."""
    reached = [matrices[0][0]]
    for m in matrices[1:]:
        reached.append(combine(reached[-1][None, :], m)[0])
    t, out = int(reached[-1].argmax()), []
    if reached[-1][t] == NONE:
        raise ValueError("no segmentation reaches the end of this text")
    for k in range(len(matrices) - 1, -1, -1):
        s = int((reached[k - 1] + matrices[k][:, t]).argmax()) if k else 0
        out.append((s, t))
        t = s
    return out[::-1]


def _giant(docs: DataFrame, shared, chunk: int) -> DataFrame:
    """(key, text) with distinct keys → (key, ids) by chunks."""
    marked = docs.select("key", F.concat(F.lit(MARK), F.translate("text", " ", MARK)).alias("m")).withColumn("size", F.length("m"))
    lo = F.col("k") * chunk
    parts = stored(marked.select("key", "m", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / chunk).cast("int"))).alias("k")).select(
        "key", "k", F.least(lo, F.lit(MARGIN)).cast("int").alias("lo"),
        F.least(F.lit(chunk), F.col("size") - lo).cast("int").alias("n"), (lo + chunk >= F.col("size")).alias("last"),
        F.substring("m", F.greatest(lo - MARGIN, F.lit(0)) + 1, F.lit(chunk + 2 * MARGIN)).alias("m")), "chunks")

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Pieces(shared.value)
        for pdf in batches:
            out = [Chunk(p, m, lo, lo + n, last).transfer() for m, lo, n, last in zip(pdf["m"], pdf["lo"], pdf["n"], pdf["last"])]
            yield pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "rows": [len(x) for x in out], "matrix": [x.tobytes() for x in out]})

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        found = resolve([np.frombuffer(m, float).reshape(r, -1) for m, r in zip(pdf["matrix"], pdf["rows"])])
        return pd.DataFrame({"_key": pdf["key"].to_numpy(), "_k": pdf["k"].to_numpy(), "s": [s for s, _ in found], "t": [t for _, t in found]})

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Pieces(shared.value)
        for pdf in batches:
            out = [Chunk(p, m, lo, lo + n, last).ids(s, t) for m, lo, n, last, s, t in
                   zip(pdf["m"], pdf["lo"], pdf["n"], pdf["last"], pdf["s"], pdf["t"])]
            yield pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "ids": out})

    states = stored(parts.mapInPandas(transfers, "key string, k int, rows int, matrix binary").groupBy("key")
                    .applyInPandas(path, "_key string, _k int, s int, t int"), "states")
    done = parts.join(states, (F.col("key") == F.col("_key")) & (F.col("k") == F.col("_k"))) \
        .mapInPandas(encoded, "key string, k int, ids array<int>")
    return done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x")) \
               .select("key", F.flatten(F.transform("x", lambda c: c["ids"])).alias("ids"), F.size("x").alias("chunks"))


def encode(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ids (array of int, those of the library) and chunks.

    Null and empty texts have no ids and no chunk's work (chunks 1); repeated
    rows each have theirs; an empty table gives no rows.  Columns of ``docs``
    named ids or chunks are replaced; all others stay."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model_bytes(path))
    whole_tokens(shared.value)  # raises if words of this model aren't independent

    @F.pandas_udf("array<int>")
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = Pieces(shared.value)
        for texts in batches:
            yield pd.Series(p.encode(texts.tolist()), dtype=object)

    docs = docs.drop("ids", "chunks")
    whole = F.coalesce(F.col(text), F.lit(""))
    is_long = F.length(whole) >= chunk
    few = docs.where(~is_long).withColumns({"ids": short(whole), "chunks": F.lit(1)})
    many = docs.where(is_long).withColumn("_pieces_key", F.sha2(whole, 256))
    texts = many.groupBy("_pieces_key").agg(F.first(whole).alias("text")).withColumnRenamed("_pieces_key", "key")
    found = _giant(texts, shared, chunk).withColumnRenamed("key", "_pieces_found")
    long = many.join(found, many["_pieces_key"] == found["_pieces_found"])
    return few.unionByName(long.select(*few.columns))


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the library decodes from its ids."""
    spark = encoded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model_bytes(path))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for rows in batches:
            yield pd.Series([sp.decode(x.tolist()) for x in rows], dtype=object)

    return encoded.withColumn(into, text(ids))


def round_trips(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_tokens, chunks, ids_sha256 (of the ids
    as decimal text, comma-separated), round_trip: whether decoding gives back
    the text, with spaces for the characters that are the model's space mark."""
    back = decode(encode(docs.select("doc_id", "text"), path, chunk=chunk), path)
    plain = F.translate(F.coalesce("text", F.lit("")), MARK, " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "chunks",
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), (F.col("decoded") == plain).alias("round_trip"))
