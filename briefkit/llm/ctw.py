"""Language-model scores by context-tree weighting over bytes.

A text is the stream of its lower-cased words, a space between them and a line
end after them.  Each byte is eight binary decisions; a decision's contexts are
the bits of the byte so far and the 0 to ``DEPTH`` bytes before.  Every context
has a Krichevsky-Trofimov estimate from its counts in the training documents,
and context-tree weighting mixes the estimates of all depths, which gives the
probability, so the code length, of each byte.

All training documents are counted, and every context that occurs stays in the
tree.  No task holds the tree or sends it: a task takes the distinct
(DEPTH+1)-byte strings of a bounded bucket of documents, scored ones too, with
their training counts; they meet by the ``PREFIX`` bytes before the predicted
one, where the subtree below these is weighted; the log probability of each
string goes back to the buckets that have it.  The levels above are the sums of
at most 2^16 nodes.

The unigram base needs the counts of all words, which have no bound: a task
numbers the words of a bounded bucket of documents from the commonest, only
sorted lists of their 64-bit hashes meet over the network, and the counts come
back to the bucket's documents.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, remainder, stored, text_bytes

DEPTH = 6
#: Strings meet by so many bytes before the predicted one.
PREFIX = 2
FOLDS, HELD_OUT = 5, 1
#: Bounds of a bucket of documents: distinct words, bytes.
BUCKET_WORDS, BUCKET_BYTES = 200_000, 16 << 20
#: Words meet by so many leading bits of their hash.
PART_BITS = 8
#: Byte strings a task holds before it sorts and counts them.
HELD = 6_000_000
#: Strings of a row of the tree.
PIECE = 500_000
U = np.uint64
#: Texts that are scored together have so many bytes, or are one text.
SCORED = 1 << 20
#: Steps of a node's log odds in one unit.
ODDS = 2048.0
FIRST_BITS = 256  # a byte's bits so far, with a leading 1


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def windows(streams: list[bytes], depth: int) -> np.ndarray:
    """Turned strings: of every byte of the streams the ``depth`` bytes before
    it, the nearest one highest, line ends before the first, then itself
    (lowest).  Sorted ones lie by their contexts."""
    pad = b"\n" * depth
    data = b"".join(pad + s for s in streams)
    size = max(0, len(data) - depth)
    key = np.empty(size, U)
    data += bytes(16)
    for r in range(min(8, size)):  # eight bytes from each place, the first lowest
        key[r::8] = np.frombuffer(data, "<u8", (size - r + 7) // 8, r)
    key = ((key & _mask(depth)) << U(8)) | ((key >> U(8 * depth)) & U(255))
    own = np.ones(size, bool)
    for end in np.cumsum([len(s) + depth for s in streams])[:-1]:
        own[end - depth:end] = False  # these would predict the next text's padding
    return key[own]


def strings(streams: list[bytes], depth: int) -> np.ndarray:
    """Of every byte of the streams: itself (lowest) and the ``depth`` bytes
    before it, line ends before the first."""
    return turned(windows(streams, depth), depth)


def turned(keys: np.ndarray, depth: int) -> np.ndarray:
    """Strings with their context backwards; its own inverse."""
    return ((keys.byteswap() << U(8)) >> U(56 - 8 * depth)) | (keys & U(255))


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(runs) == 1:
        return runs[0]
    every, n = np.concatenate([k for k, _ in runs]), np.concatenate([n for _, n in runs])
    keys = np.unique(every)
    return keys, np.bincount(np.searchsorted(keys, every), n, len(keys)).astype(np.int64)


def pack(x: np.ndarray, gaps: bool) -> bytes:
    """Integers as planes of their bytes, sorted ones as their gaps: mostly
    zeros, which the writers compress well."""
    x = np.diff(x, prepend=x.dtype.type(0)) if gaps else x
    return np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes, gaps: bool) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U).ravel()
    return np.cumsum(x, dtype=U) if gaps else x


def squeezed(x: np.ndarray, gaps: bool) -> bytes:
    return zlib.compress(pack(x, gaps), 1)


def loose(data: bytes, gaps: bool) -> np.ndarray:
    return unpack(zlib.decompress(data), gaps)


class Counted:
    """Running counts of byte strings."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0
        self.run = (np.zeros(0, U), np.zeros(0, np.int64))

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)
        if self.size > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            keys, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.run = _merged([self.run, (keys, n.astype(np.int64))])
            self.held, self.size = [], 0
        return self.run


SEEN = ("kind int, bucket long, doc_id long, held_out boolean, n_tokens long, ids binary, names binary, "
        "g int, keys binary, counts binary")
COLUMNS = [x.split()[0] for x in SEEN.split(", ")]
DOC, WORD, STRING = 0, 1, 2


#: Steps of a log probability in one unit.
LOGS = 65536.0


def _planes(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _plain(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def hashed(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, names), U, len(names))


class Bucket:
    """Documents held until their distinct words, or bytes, reach a bound."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.id = uuid.uuid4().int >> 65
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.docs: list[tuple] = []
        self.trained: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, held_out: bool, words: list[bytes]) -> None:
        own = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
        self.docs.append((doc_id, held_out, own, stream(words)))
        self.bytes += len(self.docs[-1][3])
        if not held_out:
            self.trained.append(own)

    def full(self) -> bool:
        return len(self.number) > BUCKET_WORDS or self.bytes > BUCKET_BYTES

    def frames(self) -> Iterator[pd.DataFrame]:
        """The documents with their words numbered from the commonest, the
        first one with the words, those as common in alphabetical order: small
        numbers and like neighbours squeeze well; the words' hashes and
        training counts by part, and the turned byte strings with theirs by
        the bytes they meet by."""
        names = list(self.number)
        uses = np.bincount(np.concatenate([d[2] for d in self.docs]), minlength=len(names)) if self.docs else np.zeros(0, np.int64)
        order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        order = order[np.argsort(-uses[order], kind="stable")]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        for i in range(0, len(self.docs), 500):
            some = self.docs[i:i + 500]
            yield _frame(DOC, len(some), bucket=self.id, doc_id=pd.Series([d[0] for d in some], dtype="Int64"), held_out=[d[1] for d in some],
                         n_tokens=[len(d[2]) + 1 for d in some], ids=[_planes(rank[d[2]]) for d in some],
                         names=[None if i or k else zlib.compress(b" ".join([names[j] for j in order]), 1) for k in range(len(some))])
        n = np.bincount(np.concatenate(self.trained), minlength=len(order)) if self.trained else np.zeros(len(order), np.int64)
        hashes = hashed(names)
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        yield from self._runs(WORD, hashes, n, hashes >> U(64 - PART_BITS))
        keys, n = distinct([d[3] for d in self.docs], [not d[1] for d in self.docs], self.depth)
        yield from self._runs(STRING, keys, n, keys >> U(8 * (self.depth + 1 - PREFIX)))

    def _runs(self, kind: int, keys: np.ndarray, n: np.ndarray, part: np.ndarray) -> Iterator[pd.DataFrame]:
        cuts = [*np.flatnonzero(np.diff(part, prepend=~part[:1])).tolist(), len(part)]
        for s in range(0, len(cuts) - 1, 500):
            k = cuts[s:s + 501]
            yield _frame(kind, len(k) - 1, bucket=self.id, g=part[k[:-1]].astype(np.int64), keys=[squeezed(keys[a:b], True) for a, b in zip(k, k[1:])],
                         counts=[squeezed(n[a:b], False) for a, b in zip(k, k[1:])])


def _slices(streams: list[bytes], docs: int, size: int) -> Iterator[tuple[int, int]]:
    """Runs of streams with so many of them and bytes, or one stream."""
    start, held = 0, 0
    for i, s in enumerate(streams):
        if i > start and (i - start == docs or held + len(s) > size):
            yield start, i
            start, held = i, 0
        held += len(s)
    if streams:
        yield start, len(streams)


def distinct(streams: list[bytes], trained: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct turned strings of the streams, and how often those that
    are trained on have them."""
    keys, at = np.empty(sum(map(len, streams)), U), 0
    for a, b in _slices(streams, len(streams), SCORED):
        own = windows(streams[a:b], depth)
        keys[at:at + len(own)] = (own << U(8)) | np.repeat(np.array(trained[a:b], U), [len(s) for s in streams[a:b]])
        at += len(own)
    keys.sort()
    first = np.flatnonzero(_starts(keys >> U(8)))
    n = np.add.reduceat((keys & U(255)).astype(np.uint8), first, dtype=np.int64) if len(keys) else np.zeros(0, np.int64)
    return keys[first] >> U(8), n


def _starts(sorted_: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind."""
    new = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    return new


def _frame(kind: int, size: int, **columns) -> pd.DataFrame:
    out = pd.DataFrame({c: columns.get(c, pd.Series([None] * size, dtype=object)) for c in COLUMNS if c != "kind"})
    out.insert(0, "kind", kind)
    return out


def _seen(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents → their tokens as numbers within a bucket, and the
        buckets' words and byte strings with their training counts."""
        bucket = Bucket(depth)
        for pdf in batches:
            for doc_id, held, data in zip(pdf["doc_id"], pdf["held_out"].tolist(), pdf["data"]):
                bucket.add(None if pd.isna(doc_id) else int(doc_id), held, data.lower().split())
                if bucket.full():
                    yield from bucket.frames()
                    bucket = Bucket(depth)
        yield from bucket.frames()

    return run


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of a part, from all buckets (rows sorted by part) → each bucket's
    answers, and a row without bucket with the part's tokens and words."""
    def answered(g: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        keys, n = _merged([(k, c) for _, k, c in rows])
        yield pd.DataFrame({"of": [None], "g": [g], "c": [None], "n": [int(n.sum())], "v": [int((n > 0).sum())]}).astype({"of": "Int64"})
        for i in range(0, len(rows), 200):
            some = rows[i:i + 200]
            yield pd.DataFrame({"of": [b for b, _, _ in some], "g": g, "c": [squeezed(n[np.searchsorted(keys, k)], False) for _, k, _ in some], "n": 0, "v": 0})

    last, held = None, []
    for pdf in batches:
        for b, g, k, c in zip(pdf["bucket"].tolist(), pdf["g"].tolist(), pdf["keys"], pdf["counts"]):
            if g != last and held:
                yield from answered(last, held)
                held = []
            last = g
            held.append((b, loose(k, True), loose(c, False).astype(np.int64)))
    if held:
        yield from answered(last, held)


#: Log gamma of the multiples of a half.
HALVES = np.array([0.0] + [math.lgamma(k / 2) for k in range(1, 4096)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Of multiples of a half above 0; large ones by Stirling's series."""
    k = (2 * x).astype(np.int64)
    out = HALVES[np.minimum(k, len(HALVES) - 1)]
    large = k >= len(HALVES)
    y = x[large]
    out[large] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3)
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of counts under the Krichevsky-Trofimov estimator."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - 2 * math.lgamma(0.5) - _lgamma(n0 + n1 + 1.0)


def _bits(byte: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits before bit i with a leading 1, and bit i."""
    return (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1


def _mask(depth: int) -> U:
    return U((1 << (8 * depth)) - 1)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, least: float) -> dict:
    """Weighted tree of the contexts that share their last byte.

    ``nodes[d]``: sorted keys (context << 8 | bits before) of depth d and the
    probability of a 1 if the tree's path ends there, with the root's share
    still left out; ``grams``: the deepest strings and that for their 8 bits;
    ``top``: by bits before, the depth-1 nodes' counts and log weights."""
    byte, ctx = (keys & U(255)).astype(np.int64), keys >> U(8)
    tables, kept = {}, np.ones(len(keys), bool)
    kept_at = {}
    for d in range(1, depth + 1):
        if d > 1:
            _, at = np.unique(ctx & _mask(d), return_inverse=True)
            kept = kept & (np.bincount(at, counts)[at] >= least)
        kept_at[d] = kept
        cx, by, n = (ctx & _mask(d))[kept], byte[kept], counts[kept]
        rows, ones = [], []
        for i in range(8):
            before, bit = _bits(by, i)
            rows.append((cx << U(8)) | before.astype(U))
            ones.append(n * bit)
        u, at = np.unique(np.concatenate(rows), return_inverse=True)
        n1, every = np.bincount(at, np.concatenate(ones), len(u)), np.bincount(at, np.tile(n, 8), len(u))
        tables[d] = (u, every - n1, n1)
    log_w, mix, pool = {}, {}, {}
    up = {}
    for d in range(depth, 0, -1):
        u, n0, n1 = tables[d]
        kt = _log_kt(n0, n1)
        if d == depth:
            log_w[d] = kt
            continue
        below, b0, b1 = tables[d + 1]
        up[d + 1] = np.searchsorted(u, (((below >> U(8)) & _mask(d)) << U(8)) | (below & U(255)))
        rest0, rest1 = n0 - np.bincount(up[d + 1], b0, len(u)), n1 - np.bincount(up[d + 1], b1, len(u))
        split = np.bincount(up[d + 1], log_w[d + 1], len(u)) + _log_kt(rest0, rest1)
        log_w[d] = np.logaddexp(kt, split) - math.log(2)
        mix[d] = 1 / (1 + np.exp(np.clip(split - kt, -700, 700)))
        pool[d] = (rest1 + 0.5) / (rest0 + rest1 + 1)
    nodes, sure, left = {}, np.zeros(len(tables[1][0])), np.ones(len(tables[1][0]))
    for d in range(1, depth + 1):
        u, n0, n1 = tables[d]
        kt = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            nodes[d] = (u, sure + left * kt)
        else:
            nodes[d] = (u, sure + left * (mix[d] * kt + (1 - mix[d]) * pool[d]))
            sure, left = (sure + left * mix[d] * kt)[up[d + 1]], (left * (1 - mix[d]))[up[d + 1]]
    keep = kept_at[depth]
    u, p = nodes[depth]
    grams = keys[keep]
    by = byte[keep]
    eight = np.stack([p[np.searchsorted(u, ((grams >> U(8)) << U(8)) | _bits(by, i)[0].astype(U))] for i in range(8)], axis=1) if len(grams) else np.zeros((0, 8))
    return {"nodes": nodes, "grams": (grams, eight), "top": (tables[1][0] & U(255), tables[1][1], tables[1][2], log_w[1])}


def _odds(p: np.ndarray) -> np.ndarray:
    return np.round(np.clip(np.log(p) - np.log1p(-p), -15.9, 15.9) * ODDS).astype(np.int16)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds / ODDS))


class Root:
    """The root above the subtrees: by bits before, what it adds to the
    probability of a 1 and the share that it leaves to them."""

    def __init__(self, tops: list[tuple]) -> None:
        n0, n1, below = np.zeros(FIRST_BITS), np.zeros(FIRST_BITS), np.zeros(FIRST_BITS)
        for before, a, b, w in tops:
            np.add.at(n0, before.astype(np.int64), a)
            np.add.at(n1, before.astype(np.int64), b)
            np.add.at(below, before.astype(np.int64), w)
        mix = 1 / (1 + np.exp(np.clip(below - _log_kt(n0, n1), -700, 700)))
        self.sure, self.left = mix * (n1 + 0.5) / (n0 + n1 + 1), 1 - mix

    def alone(self) -> np.ndarray:
        """Probability of a 1 where no subtree knows the context."""
        return self.sure + self.left * 0.5

    def node(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of a 1 at nodes, as log odds in steps of 1 / ODDS."""
        before = (keys & U(255)).astype(np.int64)
        return _odds(self.sure[before] + self.left[before] * p)

    def logs(self, grams: np.ndarray, eight: np.ndarray) -> np.ndarray:
        """Log10 probability of the strings' last bytes."""
        byte, out = (grams & U(255)).astype(np.int64), np.zeros(len(grams))
        for i in range(8):
            before, bit = _bits(byte, i)
            p = _chance(_odds(self.sure[before] + self.left[before] * eight[:, i]))
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out.astype(np.float32)


class Model:
    """Log10 probability of bytes: a hash table of the deepest strings, and for
    strings that training didn't have the sorted nodes of every depth."""

    def __init__(self, depth, slots, logs, nodes, root) -> None:
        self.depth, self.slots, self.logs, self.nodes, self.root = depth, slots, logs, nodes, root
        self.used = 0
        self.shift = U(64 - int(len(slots)).bit_length() + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    @classmethod
    def build(cls, depth: int, root: np.ndarray, nodes: dict, grams: np.ndarray, logs: np.ndarray) -> Model:
        size = 1 << max(20, (4 * len(grams)).bit_length())
        out = cls(depth, np.zeros(size, U), np.zeros(size, np.float32), nodes, root)
        out._insert(grams, logs)
        return out

    def _insert(self, grams: np.ndarray, logs: np.ndarray) -> None:
        """Put strings that the table lacks into it."""
        todo, slot = np.arange(len(grams)), self._slot(grams)
        while len(todo):
            free = self.slots[slot] == 0
            first = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.slots[slot[won]] = grams[todo[won]] + U(1)
            self.logs[slot[won]] = logs[todo[won]]
            lost = np.ones(len(todo), bool)
            lost[won] = False
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.slots) - 1)
        self.used += len(grams)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """By byte string: the log10 probability of its last byte."""
        out = np.zeros(len(keys))
        todo, slot, new = np.arange(len(keys)), self._slot(keys), []
        wanted = keys + U(1)
        while len(todo):
            held = self.slots[slot]
            hit = held == wanted[todo]
            out[todo[hit]] = self.logs[slot[hit]]
            new.append(todo[held == 0])
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        new = np.concatenate(new) if new else todo
        if len(new):
            strange, at = np.unique(keys[new], return_inverse=True)
            found = self._walk(strange)
            out[new] = found[at]
            if self.used + len(strange) < 0.6 * len(self.slots):  # later texts find them in the table
                self._insert(strange, found.astype(np.float32))
        return out

    def _walk(self, keys: np.ndarray) -> np.ndarray:
        byte, ctx, out = (keys & U(255)).astype(np.int64), keys >> U(8), np.zeros(len(keys))
        deepest = np.full(len(keys), self.depth)  # a context that has no node for the first bit has none
        for i in range(8):
            before, bit = _bits(byte, i)
            p, left = self.root[before].copy(), np.ones(len(keys), bool)
            for d in range(self.depth, 0, -1):
                u, q = self.nodes[d]
                todo = np.flatnonzero(left & (deepest >= d))
                if not len(u) or not len(todo):
                    continue
                want = ((ctx[todo] & _mask(d)) << U(8)) | before[todo].astype(U)
                at = np.minimum(np.searchsorted(u, want), len(u) - 1)
                hit = u[at] == want
                p[todo[hit]] = _chance(q[at[hit]])
                left[todo[hit]] = False
                if i == 0:
                    deepest[todo[~hit]] = d - 1
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        out, held, size = [], [], 0
        for t in texts:
            held.append(stream(t.lower().split()))
            size += len(held[-1])
            if size > SCORED:
                out += self._scores(held)
                held, size = [], 0
        return out + (self._scores(held) if held else [])

    def _scores(self, streams: list[bytes]) -> list[float]:
        logs = self.log10(strings(streams, self.depth)).astype(float)
        ends = np.cumsum([len(s) for s in streams])
        return np.add.reduceat(logs, np.concatenate(([0], ends[:-1]))).tolist()


@dataclass
class Packed:
    """A model as it is sent to the tasks: a few bytes a node."""
    depth: int
    root: np.ndarray
    nodes: dict[int, tuple[bytes, bytes]]
    grams: tuple[bytes, bytes]

    def open(self) -> Model:
        nodes = {d: (unpack(zlib.decompress(u), True), np.frombuffer(q, np.int16)) for d, (u, q) in self.nodes.items()}
        u, q = self.grams
        return Model.build(self.depth, self.root, nodes, unpack(zlib.decompress(u), True), np.frombuffer(q, np.float32))


def packed(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    order = np.argsort(keys)
    return zlib.compress(pack(keys[order], True), 1), values[order].tobytes()


def _nodes(keys: np.ndarray, counts: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of bit i of sorted turned strings: their first strings, each
    string's node, and the nodes' counts of 0 and 1."""
    cells = keys >> U(8 - i)
    new = _starts(cells)
    first, of = np.flatnonzero(new), (np.cumsum(new) - 1).astype(np.int32)
    n1 = np.add.reduceat(counts * ((keys >> U(7 - i)) & U(1)).astype(np.int64), first)
    return first, of, np.add.reduceat(counts, first) - n1, n1


def weigh(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, list[tuple]]:
    """Weighted tree below the ``top`` bytes that sorted turned strings share,
    all of its contexts: by string and bit the log odds of a 1 below the top
    nodes, and the top nodes (bits before, counts, log weights).

    Strings that training doesn't have count 0: they change no weight, and
    contexts that only they have give either bit 1/2."""
    levels, up = {depth: (keys, counts)}, {}
    for d in range(depth - 1, top - 1, -1):  # without the farthest byte
        k, n = levels[d + 1]
        k, at = np.unique(((k >> U(16)) << U(8)) | (k & U(255)), return_inverse=True)
        levels[d], up[d + 1] = (k, np.bincount(at, n, len(k)).astype(np.int64)), at.astype(np.int32)
    odds, tops = np.empty((8, len(keys)), np.int16), []
    for i in range(8):
        nodes = {d: _nodes(*levels[d], i) for d in levels}
        mix, parent = {}, {}
        log_w = _log_kt(*nodes[depth][2:])
        for d in range(depth - 1, top - 1, -1):
            _, of, n0, n1 = nodes[d]
            parent[d + 1] = of[up[d + 1][nodes[d + 1][0]]]
            kt, split = _log_kt(n0, n1), np.bincount(parent[d + 1], log_w, len(n0))
            log_w = np.logaddexp(kt, split) - math.log(2)
            mix[d] = 1 / (1 + np.exp(np.clip(split - kt, -700, 700)))
        first, _, n0, n1 = nodes[top]
        tops.append((_bits((levels[top][0][first] & U(255)).astype(np.int64), i)[0], n0, n1, log_w))
        sure, left = np.zeros(len(n0)), np.ones(len(n0))
        for d in range(top, depth):
            _, _, n0, n1 = nodes[d]
            kt, p = (n1 + 0.5) / (n0 + n1 + 1), parent[d + 1]
            sure, left = (sure + left * mix[d] * kt)[p], (left * (1 - mix[d]))[p]
        _, of, n0, n1 = nodes[depth]
        odds[i] = _odds(sure + left * (n1 + 0.5) / (n0 + n1 + 1))[of]
    return odds, tops


class Upper:
    """The levels above depth 2: by the nearest byte and the bits before, what
    they add to the probability of a 1 and the share that they leave below."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> None:
        kt = _log_kt(n0, n1)
        mix = 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))
        before = np.tile(np.arange(FIRST_BITS), len(n0))
        root = Root([(before, n0.ravel(), n1.ravel(), (np.logaddexp(kt, below) - math.log(2)).ravel())])
        self.sure = root.sure + root.left * mix * (n1 + 0.5) / (n0 + n1 + 1)
        self.left = root.left * (1 - mix)

    def logs(self, keys: np.ndarray, odds: np.ndarray, depth: int) -> np.ndarray:
        """Log10 probability of the turned strings' last bytes."""
        byte, near, out = (keys & U(255)).astype(np.int64), (keys >> U(8 * depth)).astype(np.int64), np.zeros(len(keys))
        for i in range(8):
            before, bit = _bits(byte, i)
            p = self.sure[near, before] + self.left[near, before] * _chance(odds[i])
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out.astype(np.float32)


def _by_part(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator]]:
    """Rows sorted by part → each part with an iterator of its rows."""
    rows = (r for pdf in batches for r in pdf.itertuples(index=False))
    return groupby(rows, key=lambda r: r.g)


def probabilities(strings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Turned byte strings of buckets with their training counts (bucket, g,
    keys, counts) → their log10 probabilities (of, g, c: in steps of -1 / LOGS)."""
    def weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, rows in _by_part(batches):
            run, held, size = (np.zeros(0, U), np.zeros(0, np.int64)), [], 0
            for r in rows:
                held.append((loose(r.keys, True), loose(r.counts, False).astype(np.int64)))
                size += len(held[-1][0])
                if size > max(1 << 20, len(run[0])):
                    run, held, size = _merged([run, *held]), [], 0
            keys, n = _merged([run, *held])
            odds, tops = weigh(keys, n, depth, PREFIX)
            top = np.stack([np.concatenate([t[j] for t in tops]).astype(float) for j in range(4)]).tobytes()
            for i in range(0, len(keys), PIECE):
                yield pd.DataFrame({"g": [g], "piece": [i], "keys": [squeezed(keys[i:i + PIECE], True)], "odds": [odds[:, i:i + PIECE].tobytes()],
                                    "top": [None if i else top]})

    met = strings.select("g", "keys", "counts").repartition("g").sortWithinPartitions("g")
    tree = stored(met.mapInPandas(weighted, "g int, piece long, keys binary, odds binary, top binary"), "tree")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, top in zip(pdf["g"].tolist(), pdf["top"]):
                before, n0, n1, w = np.frombuffer(top).reshape(4, -1)
                yield pd.DataFrame({"near": g >> 8, "before": before.astype(np.int64), "n0": n0, "n1": n1, "w": w})

    tops = tree.where("top is not null").select("g", "top").mapInPandas(summed, "near int, before int, n0 double, n1 double, w double")
    n = np.zeros((3, 256, FIRST_BITS))
    for r in tops.groupBy("near", "before").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "w")]).collect():  # at most 2^16 nodes
        n[:, r["near"], r["before"]] = r["n0"], r["n1"], r["w"]
    upper = Upper(*n)

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logs = [upper.logs(loose(k, True), np.frombuffer(q, np.int16).reshape(8, -1), depth).tobytes() for k, q in zip(pdf["keys"], pdf["odds"])]
            yield pdf[["g", "piece", "keys"]].assign(logs=logs)

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g, rows in _by_part(batches):
            known, steps = [], []
            for r in rows:
                if r.logs is not None:  # the part's tree comes first
                    known.append(loose(r.keys, True))
                    steps.append(np.round(np.frombuffer(r.logs, np.float32) * -LOGS).astype(np.uint32))
                    continue
                if len(known) > 1:
                    known, steps = [np.concatenate(known)], [np.concatenate(steps)]
                out.append((r.of, g, _planes(steps[0][np.searchsorted(known[0], loose(r.keys, True))])))
                if len(out) == 200:
                    yield pd.DataFrame(out, columns=["of", "g", "c"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["of", "g", "c"])

    none = F.lit(None)
    trees = tree.select("g", "piece", "keys", "odds").mapInPandas(finished, "g int, piece long, keys binary, logs binary")
    asked = strings.select("g", F.lit(-1).cast("long").alias("piece"), "keys", none.cast("binary").alias("logs"), F.col("bucket").alias("of"))
    both = trees.select("g", "piece", "keys", "logs", none.cast("long").alias("of")).unionAll(asked)
    met = both.repartition("g").sortWithinPartitions("g", F.col("logs").isNull(), "piece")
    return met.select("g", "keys", "logs", F.coalesce("of", F.lit(-1)).alias("of")).mapInPandas(answered, "of long, g int, c binary")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.  ``depth`` is 2 to 6 bytes.

    Null texts count as empty, which is the end alone; rows that repeat id and
    text have equal scores; null ids fall in the fold of the empty id; without
    training documents every byte has probability 1/256; an empty table gives
    no rows; other columns are not read."""
    if not PREFIX <= depth <= 6:
        raise ValueError(f"depth {depth} is not {PREFIX} to 6")
    prepare(docs.sparkSession)
    data = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_bytes(docs[text]).alias("data"),
                       (remainder(docs[doc_id], FOLDS) == HELD_OUT).alias("held_out"))
    seen = stored(data.mapInPandas(_seen(depth), SEEN), "tokens")
    rows, words, strings_ = (seen.where(f"kind = {k}") for k in (DOC, WORD, STRING))
    answers = stored(words.select("bucket", "g", "keys", "counts").repartition("g").sortWithinPartitions("g")
                     .mapInPandas(_counts, "of long, g int, c binary, n long, v long"), "words")
    ends = rows.where("not held_out").count()
    size = answers.where("of is null").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = (size["n"] or 0) + ends, (size["v"] or 0) + (ends > 0)
    answers = answers.where("of is not null").select("of", F.lit(WORD).alias("kind"), "g", "c") \
        .unionAll(probabilities(strings_, depth).select("of", F.lit(STRING).alias("kind"), "g", "c"))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("g")
        parts = [loose(c, False) for c in right["c"][right["kind"] == WORD]]
        words = next((zlib.decompress(x) for x in left["names"] if x is not None), b"")
        names = words.split(b" ") if words else []
        c = np.zeros(len(names))
        c[np.argsort(hashed(names))] = np.concatenate(parts) if parts else np.zeros(0)  # they come in the order of the hashes
        logs = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        end = math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        known, sums = [], []
        for ids in left["ids"]:
            own = _plain(ids)
            known.append(int((c[own] > 0).sum()) + (ends > 0))
            sums.append(float(logs[own].sum()) + end)
        names = np.array(names, object)
        streams = [stream(names[_plain(ids)].tolist()) for ids in left["ids"]]
        of_strings = np.concatenate([_plain(c) for c in right["c"][right["kind"] == STRING]]) / -LOGS
        return pd.DataFrame({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": left["n_tokens"], "n_known": known,
                             "train_tokens": n, "base_score": sums, "score": _sums(streams, of_strings, depth)})

    return rows.select("bucket", "doc_id", "held_out", "n_tokens", "ids", "names").groupBy("bucket").cogroup(answers.groupBy("of")) \
        .applyInPandas(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sums(streams: list[bytes], logs: np.ndarray, depth: int) -> np.ndarray:
    """Each stream's sum, given the values of the bucket's distinct strings."""
    known = distinct(streams, [False] * len(streams), depth)[0]
    out = []
    for a, b in _slices(streams, 256, SCORED):
        keys = (windows(streams[a:b], depth) << U(8)) | np.repeat(np.arange(b - a, dtype=U), [len(s) for s in streams[a:b]])
        keys.sort()
        own = keys >> U(8)
        new = _starts(own)
        values = logs[np.searchsorted(known, own[new])]
        out.append(np.bincount((keys & U(255)).astype(np.int64), values[np.cumsum(new) - 1], b - a))
    return np.concatenate(out)
