"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled
text.  A text is parsed into the longest phrases that occur in the sample:
its first phrase is the longest prefix that does, the next begins after it.
The fewer phrases, the closer the language; a phrase is charged log2 of the
sample's length, as a pointer into it would cost, per symbol of the text.

The automaton, with its missing edges led back through the root, is one
table: a step is one lookup, and its lowest bit says whether a phrase ended.
Texts are cut into segments of ``SEGMENT`` symbols, each parsed from the
root, so that one numpy step moves thousands of segments; a cut costs every
language the same phrase.  All symbols of all texts are parsed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import aside, prepare, remainder

#: Bound of the training sample: rows and code points of a language.
SAMPLE_ROWS, SAMPLE_CHARS = 48, 24_000
#: The most frequent letters of the samples have one symbol each; every other
#: letter of a sample is a lead and trails, so it too has its own spelling.
#: Only letters that no sample has share a symbol.
LETTERS, LEADS, TRAILS = 61, 8, 16
SEGMENT = 512
UNKNOWN = "und"
PAD, GAP, OTHER, FIRST = 0, 1, 2, 3
FOLDS, HELD_OUT = 5, 0


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower case (where that
    is one code point)."""
    n = 0x110000
    letter, lower = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for c in range(n):
        if chr(c).isalpha():
            letter[c] = True
            if len(low := chr(c).lower()) == 1:
                lower[c] = ord(low)
    return letter, lower


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Alphabet:
    """How code points are spelled in symbols."""
    symbol: np.ndarray  # by code point: its first symbol
    rank: np.ndarray    # by code point: row of ``tails``
    tails: np.ndarray   # the trails of letters that begin with a lead
    width: int

    def spell(self, text: str) -> np.ndarray:
        """A text's symbols; runs of what is no letter become one gap."""
        points = _points(text)
        out = self.symbol[points]
        gap = out == GAP
        kept = ~(gap & np.concatenate(([False], gap[:-1])))
        out = out[kept]
        if not len(self.tails):
            return out
        points, long = points[kept], out >= FIRST + LETTERS
        n = self.tails.shape[1]
        size = 1 + n * long.astype(np.int64)
        spelled = np.repeat(out, size)
        at = (np.cumsum(size) - size)[long]
        spelled[at[:, None] + np.arange(1, n + 1)] = self.tails[self.rank[points[long]]]
        return spelled


def alphabet(counts: Counter) -> Alphabet:
    """From the counts of lower-case letters, by code point."""
    letter, lower = _letters()
    order = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    first = np.where(letter, OTHER, GAP).astype(np.uint8)
    few, rest = order[:LETTERS], np.array(order[LETTERS:], np.int64)
    code = np.full(0x110000, -1, np.int64)   # by lower-case code point: place among all
    code[order] = np.arange(len(order))
    place = np.where(letter, code[lower], -1)
    own = place >= 0
    n = 0
    while LEADS * TRAILS ** n < len(rest):
        n += 1
    lead = FIRST + LETTERS + (np.arange(len(rest)) // TRAILS ** n if len(rest) else np.zeros(0, np.int64))
    begin = np.concatenate((FIRST + np.arange(len(few)), lead)).astype(np.uint8)
    first[own] = begin[place[own]]
    index = np.arange(len(rest))
    tails = np.stack([index // TRAILS ** k % TRAILS for k in reversed(range(n))], 1) if n else np.zeros((0, 0), np.int64)
    width = FIRST + LETTERS + (LEADS + TRAILS if len(rest) else 0)
    return Alphabet(first, np.where(place >= LETTERS, place - LETTERS, 0).astype(np.int32), (FIRST + LETTERS + LEADS + tails).astype(np.uint8), width)


def automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Suffix automaton of a sample as a step table: entry [state * width + s]
    is (next state * width) * 2 + 1 if the phrase ended before s, else + 0.  A
    symbol that the sample lacks is a phrase; it leads to a last state, from
    which every symbol begins a phrase."""
    link, length, edges, last = [-1], [0], [{}], 0
    for s in symbols.tolist():
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        p = last
        while p >= 0 and s not in edges[p]:
            edges[p][s] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][s]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(s) == q:
                    edges[p][s] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    root = np.full(width, len(edges), np.int64)
    for s, t in edges[0].items():
        root[s] = t
    table = np.tile(root * width * 2 + 1, (len(edges) + 1, 1))
    for state, out in enumerate(edges):
        for s, t in out.items():
            table[state, s] = t * width * 2
    table[:, PAD] = np.arange(len(edges) + 1) * width * 2
    table[0, [x for x in range(1, width) if x not in edges[0]]] -= 1  # the first phrase is counted already
    return table.astype(np.int32).ravel()


@dataclass
class Model:
    langs: list[str]
    letters: Alphabet
    tables: list[np.ndarray]
    bits: list[float]  # of a phrase

    def rates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol, by text and language; whether a text has a letter."""
        rows = [self.letters.spell(t) for t in texts]
        has = np.array([bool((r >= OTHER).any()) for r in rows], bool)
        sizes = np.array([len(r) for r in rows], np.int64)
        parts = -(-sizes // SEGMENT)
        flat = np.zeros((int(parts.sum()), SEGMENT), np.uint8)
        ends = np.cumsum(parts)
        for r, a, b in zip(rows, (ends - parts).tolist(), ends.tolist()):
            flat[a:b].reshape(-1)[:len(r)] = r
        owner = np.repeat(np.arange(len(texts)), parts)
        steps = np.ascontiguousarray(flat.T)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(flat):
            return out, has
        for k, (table, bits) in enumerate(zip(self.tables, self.bits)):
            at, phrases = np.zeros(len(flat), np.int32), np.ones(len(flat), np.int32)
            for s in steps:
                v = table.take((at >> 1) + s)
                phrases += v & 1
                at = v
            out[:, k] = np.bincount(owner, phrases, len(texts)) * bits / np.maximum(sizes, 1)
        return out, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        rates, has = self.rates(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = rates.argmin(axis=1)
        if len(self.langs) == 1:
            score = np.ones(len(texts))
        else:
            two = np.sort(rates, axis=1)[:, :2]
            score = two[:, 1] / np.maximum(two.sum(axis=1), 1e-300)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0)


def fit(samples: dict[str, str]) -> Model:
    """Model of the languages' sample texts; those without a letter are left out."""
    letter, lower = _letters()
    points = {k: _points(v) for k, v in samples.items()}
    points = {k: v for k, v in sorted(points.items()) if letter[v].any()}
    seen: Counter[int] = Counter()
    for v in points.values():
        seen.update(lower[v[letter[v]]].tolist())
    letters = alphabet(seen)
    texts = [letters.spell(samples[k]) for k in points]
    return Model(list(points), letters, [automaton(t, letters.width) for t in texts], [float(np.log2(len(t) + 1)) for t in texts])


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """The bounded sample to learn from: of each language the ``rows`` labelled
    documents outside the held-out fold with the smallest hash of their id,
    ``chars`` code points together."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    ids = [r["doc_id"] for r in picked.select("doc_id").distinct().collect()]
    share = F.substring("text", 1, chars).alias("text")
    texts = known.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", share).collect() if ids else []
    out: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], str(r["doc_id"]), r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    # an even share of each document, so that one long text doesn't fill it
    return {k: "\n".join(t[:max(1, chars // len(v))] for t in v) for k, v in out.items()}


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.letters, model.tables, model.bits))

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Model(*shared.value)
        for texts in batches:
            langs, scores = known.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype="str"), "score": scores})

    p = of(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn("_p", p).withColumns({"lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p")


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The score is the runner-up's share of the bits that both need: 0.5 in a
    tie, 1 if only one language is known.  Ties go to the first language by
    name.  Null texts and those without a letter are ``und`` with score 0, and
    so is every text if no labelled one can be learned from.  Null ids and
    repeated rows are kept as they are; an empty table gives no rows; lang and
    doc_id only choose the training sample; other columns are not read."""
    prepare(docs.sparkSession)
    model = fit(training_sample(docs))
    return predicted(docs.select("doc_id", "text"), model) \
        .select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with the columns of
    ``docs``; those that are ``und`` go."""
    prepare(docs.sparkSession)
    model = fit(training_sample(docs))
    plain, back = aside(docs)
    return back(predicted(plain, model).where(F.col("lang_pred") != UNKNOWN))
