import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql.types import LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType()),
                     # names that the operators use themselves
                     StructField("size", StringType()), StructField("ids", StringType()), StructField("score", StringType())])


def edge_rows() -> list[tuple]:
    """Null, empty, blank and letterless texts, one without blanks, long ones,
    copies up to blanks and case, near copies, repeated rows, null columns."""
    words = "the quick brown fox jumps over the lazy dog while seven grey geese watch from a distant hill and say nothing at all".split()
    base = " ".join(f"{w}{i % 9}" for i, w in enumerate(words * 12))
    near = base.replace("fox1", "cat1", 1)
    giant = "\n".join(" ".join(f"w{(i * j) % 977}" for j in range(1, 60)) for i in range(1, 160)) + "x" * 20_000
    texts = [None, "", "   ", " \t\n", "12 34 !?", "word", "two  words ", base, base.upper(), base.replace(" ", "\n"), near,
             giant, giant + " end", "日本語のテキスト " * 30, "ß é ñ ▁ mark ▁▁", "line one of some words\n" * 40, "\n\n\n", "a\x00b", "x" * 300]
    out = [(1000 + i, t, "en" if i % 3 else None, [None, "s1", "s2"][i % 3], len(t or ""), "z", "y", "x") for i, t in enumerate(texts)]
    return out + [out[7], out[7], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows(spark) -> list[tuple]:
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars, None, None, None) for r in docs] + edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def by_value():
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
