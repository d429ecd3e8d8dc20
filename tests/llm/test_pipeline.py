"""The pipeline's stages against plain Python, and the registration."""

import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from briefkit.llm import mixing, queries
from briefkit.llm.tokencount import MODEL

from .test_dedup import joined, key, plain_simhash

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    import __spark_entry__ as E

    names = E.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages(spark, docs):
    held = {(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()}
    rows, one = docs.where("doc_id is not null").dropDuplicates(["doc_id"]), None
    kept = {d: t for d, t in held if any(c.isalpha() for c in t or "")}
    one = P.language(spark, rows, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept.keys()

    groups = defaultdict(list)
    for d, t in kept.items():
        groups[key(t)].append((-len(t), d))
    kept = {min(g)[1]: kept[min(g)[1]] for g in groups.values()}
    two = P.exact(spark, one, SF)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == kept.keys()

    ids = sorted(kept)
    prints = [plain_simhash(kept[d]) for d in ids]
    label = joined(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    kept = {d: kept[d] for i, d in enumerate(ids) if label[i] == i}
    three = P.near(spark, two, SF)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == kept.keys()

    copies = Counter({r.doc_id: r.copies for r in mixing.mix(three).collect()})
    four = P.mix(spark, three, SF)
    assert four.columns == docs.columns and Counter(r.doc_id for r in four.collect()) == +copies

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    for r in P.encode(spark, four, SF).collect():
        ids = sp.encode(kept[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.round_trip


def test_run_over_a_table(spark):
    out = P.run(spark, SF).collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_empty_documents(spark, docs):
    out = docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0


def test_repeated_ids_share_copies(spark):
    rows = [(1, "a b c " * 50, "s"), (1, "d e f " * 50, "s"), (2, "g h " * 40, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sum(r.copies for r in mixing.mix(df).collect())
    assert mixing.mixed(df).count() == want
