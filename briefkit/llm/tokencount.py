"""Token counts of a SentencePiece model by the whole-token shortcut.

No piece of such a model has a space mark after another character, so no
merge crosses from one pre-token (a run of spaces and the characters up to the
next space) to the next, and a text's count is the sum of its pre-tokens'.
Before any text is read, every piece that begins with the space mark is encoded
alone; those that give one token are pre-tokens of count one, known without
merging.  The library merges only the others, each once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import prepare

MODEL, LIMIT = "piece_bpe_32k.model", 4096
MARK = "▁"
#: Pre-tokens that a task remembers; beyond it, it starts again with the whole tokens.
REMEMBERED = 300_000


class PreTokens:
    """A model's counts by pre-token, given without its first space mark."""

    def __init__(self, model: bytes, whole: list[str]) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def split(self, text: str) -> list[str]:
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]

    def merge(self, new: list[str]) -> None:
        """Count pre-tokens by the library.  One of spaces alone ends its text
        and is what it adds to a word."""
        words = [x for x in new if x.strip(" ")]
        self.known |= zip(words, map(len, self.sp.encode(words, num_threads=1)))
        for x in new:
            if not x.strip(" "):
                self.known[x] = len(self.sp.encode("x " + x)) - len(self.sp.encode("x"))

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) if t else [] for t in texts]
        met = set().union(*parts)
        if len(self.known) + len(met) > REMEMBERED:
            self.known = dict(self.whole)
        if new := met - self.known.keys():
            self.merge(list(new))
        return [sum(map(self.known.__getitem__, p)) for p in parts]


def whole_tokens(model: bytes) -> list[str]:
    """Offline proof for a model: the pre-tokens (without the first space mark)
    that encode alone as one token.  ValueError if pre-tokens aren't
    independent in this model."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece of this model goes over a space")
    if sp.encode("a  b ", out_type=str) != sp.encode("a", out_type=str) + sp.encode(" b", out_type=str) + [MARK]:
        raise ValueError("this model drops or adds spaces")
    words = [p[1:] for p in pieces if p[0] == MARK and p.strip(MARK)]
    return [w for w, ids in zip(words, sp.encode(words)) if len(ids) == 1]


def model_bytes(path: str) -> bytes:
    """A model's file, read once on the driver: its size is fixed."""
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty, with no bytes and no tokens; null ids and
    repeated rows are kept as they are; an empty table gives no rows; other
    columns are not read."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    model = model_bytes(path)
    shared = spark.sparkContext.broadcast((model, whole_tokens(model)))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = PreTokens(*shared.value)
        for texts in batches:
            yield pd.Series(known.count(texts.tolist()), dtype="int64")

    whole = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[doc_id].alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), tokens(whole).alias("n_tokens")) \
               .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
