"""From raw documents to token ids: five operators, one after the other.

Each stage works on all that the one before it kept.  All but the last return
the columns of ``documents``; the last returns what a trainer reads.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefkit.llm import exactdedup, langid, mixing, pieces, simhash
from briefkit.llm.shared import stored
from briefkit.llm.tokencount import MODEL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised (no letter in them) go."""
    return langid.with_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exactdedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return simhash.one_of_each(docs, shingle=4, max_bits=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip (decoding gives the
    text), a row for each row of ``docs``."""
    path = public_tokenizers.path(MODEL)
    back = pieces.decode(pieces.encode(docs.select("doc_id", "lang", "source", "text"), path), path)
    plain = F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == plain).alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: SQL can express neither the fingerprints nor the token ids; the tests hold
#: the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
