"""Token counts, SentencePiece by chunks, languages and scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from briefkit.llm import ctw, langid, pieces, tokencount

PATH = public_tokenizers.path(tokencount.MODEL)
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_token_counts(docs, rows, none):
    want = Counter()
    for r in rows:
        n = len(LIB.encode(r[1] or ""))
        want[(r[0], len((r[1] or "").encode()), n, n > 4096)] += 1
    assert Counter(map(tuple, tokencount.token_counts(docs, PATH).collect())) == want
    assert tokencount.token_counts(none, PATH).count() == 0


def test_token_counts_forget(monkeypatch):
    """A task that remembers too few words still counts each batch whole."""
    monkeypatch.setattr(tokencount, "REMEMBERED", 5)
    model = tokencount.model_bytes(PATH)
    known = tokencount.PreTokens(model, tokencount.whole_tokens(model))
    for batch in (["a b  c ", "zxqv wvut"], ["zxqv b", "", " ", "▁x y▁"]):
        assert known.count(batch) == [len(LIB.encode(t)) for t in batch]


def test_encoding(docs, rows, none):
    got = Counter(map(tuple, pieces.round_trips(docs, PATH, chunk=4096).collect()))
    want = Counter()
    for r in rows:
        ids = LIB.encode(r[1] or "")
        n = len(r[1] or "")
        want[(r[0], len(ids), 1 if n < 4096 else -(-(n + 1) // 4096), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True)] += 1
    assert got == want
    kept = pieces.encode(docs, PATH)
    assert set(kept.columns) == set(docs.columns) | {"chunks"}
    assert pieces.round_trips(none, PATH).count() == 0


def chunked(p, text, size):
    marked, parts = pieces.MARK + text.replace(" ", pieces.MARK), []
    for lo in range(0, len(marked), size):
        a = max(lo - pieces.MARGIN, 0)
        n = min(size, len(marked) - lo)
        parts.append(pieces.Chunk(p, marked[a:a + size + 2 * pieces.MARGIN], lo - a, lo - a + n, lo + size >= len(marked)))
    found = pieces.resolve([c.transfer() for c in parts])
    return [i for c, (s, t) in zip(parts, found) for i in c.ids(s, t)]


def test_chunks_give_the_library_s_ids():
    p, rnd = pieces.Pieces(tokencount.model_bytes(PATH)), random.Random(5)
    texts = ["x" * 300, " " * 150, "  a   b  ", "internationalization" * 12, "日本語テキスト퟿" * 20, "\n" * 99, "▁▁ ▁x" * 30,
             *["".join(rnd.choice(a) for _ in range(400)) for a in ("aeinrst \n▁éß漢", "theinaers", "ab ", "0123456789.,")]]
    for t in texts:
        for size in (33, 64, 97):
            assert chunked(p, t, size) == LIB.encode(t), (t[:20], size)


def test_products_are_associative():
    rnd = np.random.default_rng(1)
    a, b, c = (np.where(rnd.random((4, 4)) < 0.4, pieces.NONE, rnd.integers(-9, 0, (4, 4))) for _ in range(3))
    assert np.array_equal(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))


def phrases(text, sample):
    """Longest-match parsing by substring search."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i:i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_automaton_parses_into_longest_phrases():
    rnd = random.Random(2)
    sample = [rnd.randrange(3, 8) for _ in range(400)]
    width = langid.FIRST + 10
    table = langid.automaton(np.array(sample, np.uint8), width)
    for _ in range(20):
        text = [rnd.randrange(3, 9) for _ in range(60)]
        at, n = 0, 1
        for s in text:
            at = int(table[(at >> 1) + s])
            n += at & 1
        as_text = lambda x: "".join(map(chr, x))
        assert n == phrases(as_text(text), as_text(sample))


def test_language(spark, docs, rows, none):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in known.select("doc_id", "lang").collect()}
    found = langid.identify(known).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found) and len(found) == len(truth)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    got = langid.identify(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    plain = {r[0]: any(c.isalpha() for c in r[1] or "") for r in rows if r[0] is not None}
    assert all((r.lang_pred != "und") == plain[r.doc_id] for r in got if r.doc_id is not None)
    left = langid.with_language(docs)
    assert left.columns == docs.columns and left.count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    assert langid.identify(none).count() == 0
    nothing = langid.identify(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_does_not_learn_from_held_out_rows(spark):
    rows = [(i, "zyx wvu " * 9 if zlib.crc32(str(i).encode()) % 5 == 0 else "abc def " * 9, "q" if zlib.crc32(str(i).encode()) % 5 == 0 else "a")
            for i in range(60)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"a"}


def test_scores(docs, rows, none):
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower()) for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in [*t, None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r, t, h in zip(rows, tokens, held):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, None])
        want[(r[0], h, len(t) + 1, sum(c[w] > 0 for w in [*t, None]), n, round(base, 3))] += 1
    got = ctw.score(docs).collect()
    assert Counter((*r[:5], round(r[5], 3)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert ctw.score(none).count() == 0


def model_of(keys, n, depth, least):
    trees = []
    for g in np.unique(keys >> np.uint64(8) & np.uint64(255)):
        own = keys >> np.uint64(8) & np.uint64(255) == g
        trees.append(ctw.subtree(keys[own], n[own], depth, least))
    root = ctw.Root([t["top"] for t in trees])
    nodes = {}
    for d in range(1, depth + 1):
        u, p = (np.concatenate([t["nodes"][d][i] for t in trees]) for i in (0, 1))
        nodes[d] = ctw.packed(u, root.node(u, p))
    grams, eight = (np.concatenate([t["grams"][i] for t in trees]) for i in (0, 1))
    return ctw.Packed(depth, root.alone(), nodes, ctw.packed(grams, root.logs(grams, eight))).open()


def plain_ctw(texts, depth):
    """Probability of a byte after a context by the definition: recursion over
    dictionaries of bit counts, no numpy."""
    counts = {}
    for t in texts:
        s = b"\n" * depth + t
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                node = s[i - d:i]
                for k in range(8):
                    cell = counts.setdefault((node, 1 << k | s[i] >> 8 - k), [0, 0])
                    cell[s[i] >> 7 - k & 1] += 1

    def kt(n):
        return math.lgamma(n[0] + .5) + math.lgamma(n[1] + .5) - 2 * math.lgamma(.5) - math.lgamma(sum(n) + 1)

    children = {}
    for node, before in counts:
        if node:
            children.setdefault((node[1:], before), []).append(node)

    def weight(node, before):
        own = kt(counts[node, before])
        if len(node) == depth:
            return own
        split = sum(weight(x, before) for x in children[node, before])
        top = max(own, split)
        return top + math.log(.5 * math.exp(own - top) + .5 * math.exp(split - top))

    def one(context, before, d=0):
        node = context[len(context) - d:]
        if (node, before) not in counts:
            return 0.5
        n = counts[node, before]
        est = (n[1] + .5) / (sum(n) + 1)
        if d == depth:
            return est
        own, split = kt(n), sum(weight(x, before) for x in children[node, before])
        mix = 1 / (1 + math.exp(min(700, max(-700, split - own))))
        return mix * est + (1 - mix) * one(context, before, d + 1)

    def log10(t):
        s, out = b"\n" * depth + t, 0.0
        for i in range(depth, len(s)):
            for k in range(8):
                p = one(s[i - depth:i], 1 << k | s[i] >> 8 - k)
                out += math.log10(p if s[i] >> 7 - k & 1 else 1 - p)
        return out

    return log10


def test_tree_matches_its_definition():
    train = [b"the cat sat\n", b"the hat\n", b"\n", b"a cat and a hat sat\n"]
    depth = 3
    counted = ctw.Counted()
    counted.add(ctw.strings(train, depth))
    keys, n = counted.settle()
    model, plain = model_of(keys, n, depth, 0.0), plain_ctw(train, depth)
    for t in (b"the cat\n", b"zebra hat the\n", b"\n"):
        assert float(model.log10(ctw.strings([t], depth)).sum()) == pytest.approx(plain(t), rel=1e-3)


def test_tree_is_a_distribution():
    """All bytes after any context add up to one, pooled contexts included."""
    train = [b"aab abc abd\n" * 5, b"xyz\n"]
    depth = 2
    keys, n = np.unique(ctw.strings(train, depth), return_counts=True)
    for least in (0.0, 4.0, 1e9):
        model = model_of(keys, n, depth, least)
        for context in (b"ab", b"qq", b"\n\n", b"za"):
            all_bytes = np.array([context[0] << 16 | context[1] << 8 | b for b in range(256)], np.uint64)
            assert float((10 ** model.log10(all_bytes)).sum()) == pytest.approx(1, abs=1e-4)


def test_scores_match_the_definition(spark):
    """Scores through the whole job, texts that training lacks included."""
    texts = ["The cat sat", "the hat", "", "a  cat and\ta hat sat", "zebra hat the", "é ü", "the cat sat"] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    streams = [ctw.stream(t.encode().lower().split()) for t in texts]
    plain = plain_ctw([s for s, h in zip(streams, held) if not h], 3)
    got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), depth=3).collect()}
    assert any(held) and got == {i: pytest.approx(plain(s), rel=1e-3) for i, s in enumerate(streams)}


def test_rare_contexts_stay_in_the_tree(spark):
    """Contexts under 2^-20 of the training bytes, which were pooled once."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=1500))) for i in range(1000)]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    streams = [ctw.stream(t.encode().split()) for _, t in rows]
    keys, n = np.unique(ctw.strings([s for s, h in zip(streams, held) if not h], ctw.DEPTH), return_counts=True)
    assert n.sum() > 1 << 20 and (n == 1).any()
    model = model_of(keys, n, ctw.DEPTH, 0.0)
    got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == pytest.approx(want, rel=1e-3) for (i, _), want in zip(rows, model.scores([t.encode() for _, t in rows])))


def test_buckets_squeeze_their_documents(spark):
    """Numbers of words and the words are stored and shuffled: few bytes of each."""
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlu", k=7)) for _ in range(20000)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=400)) for _ in range(300)]
    bucket = ctw.Bucket(ctw.DEPTH)
    for i, t in enumerate(texts):
        bucket.add(i, i % 5 == 1, t.encode().split())
    frames = [f for f in bucket.frames() if (f["kind"] == ctw.DOC).all()]
    size = sum(len(x) for f in frames for c in ("ids", "names") for x in f[c] if x is not None)
    assert size < 0.32 * sum(map(len, texts))


def test_packing():
    x = np.array([0, 3, 3 << 40, (1 << 63) + 5], np.uint64)
    assert np.array_equal(ctw.unpack(ctw.pack(x, True), True), x) and np.array_equal(ctw.unpack(ctw.pack(x, False), False), x)


def test_encoding_keeps_columns_with_its_own_names(spark):
    """Columns that the operator uses itself, on short and giant texts."""
    giant = "some words and more " * 60
    rows = [(1, "short text", "a", 7, "k"), (2, giant, "b", 8, "l"), (3, giant, None, 9, "m"), (4, None, "d", 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, k int, _key string")
    got = pieces.encode(df, PATH, chunk=200)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert got.columns == [*df.columns, "ids", "chunks"]
    assert sorted((r.doc_id, r.text, r.key, r.k, r._key, list(r.ids)) for r in got.collect()) == [(*r, sp.encode(r[1] or "")) for r in rows]
    assert got.where("doc_id = 2").first().chunks > 1


def scripts():
    dice = random.Random(3)

    def text(base, n):
        words = ["".join(chr(base + dice.randrange(n)) for _ in range(dice.randint(2, 6))) for _ in range(80)]
        return lambda: " ".join(dice.choices(words, k=60))
    return {"large": text(0x4E00, 200), "larger": text(0x4F00, 900), "latin": text(ord("a"), 26), "cyrillic": text(0x430, 32)}


def test_scripts_of_many_letters_are_told_apart():
    kinds = scripts()
    samples = {k: "\n".join(f() for _ in range(20)) for k, f in kinds.items()}
    model = langid.fit(samples)
    for k, f in kinds.items():
        assert model.predict([f() for _ in range(20)])[0] == [k] * 20
    letters = {c for t in samples.values() for c in t.lower() if c.isalpha()}
    assert len(letters) > 300
    assert len({tuple(model.letters.spell(c).tolist()) for c in letters}) == len(letters)


def test_rates_by_brute_force():
    """Phrases by substring search over spelled segments, bits by definition."""
    kinds = scripts()
    samples = {k: "\n".join(f() for _ in range(3)) for k, f in kinds.items()}
    model = langid.fit(samples)
    texts = [f() + " 42 " + f() for f in kinds.values()] + ["", "!?", "ж", "a" * 1500, "日本 unknown ß"]
    rates, has = model.rates(texts)
    for i, t in enumerate(texts):
        symbols = model.letters.spell(t)
        assert has[i] == any(c.isalpha() for c in t)
        for j, lang in enumerate(model.langs):
            known = "".join(map(chr, model.letters.spell(samples[lang])))
            parts = ["".join(map(chr, symbols[a:a + langid.SEGMENT])) for a in range(0, len(symbols), langid.SEGMENT)]
            want = sum(phrases(p, known) for p in parts) * math.log2(len(known) + 1) / max(len(symbols), 1)
            assert rates[i, j] == pytest.approx(want), (t[:20], lang)
