"""Near, exact and passage duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from briefkit.llm import components, exactdedup, passages, simhash


def joined(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash_classes(docs, rows):
    prints = [plain_simhash(r[1]) for r in rows]
    one = sorted(set(prints))
    label = joined(len(one), [(i, j) for i in range(len(one)) for j in range(i) if (one[i] ^ one[j]).bit_count() <= 4])
    place = {p: label[i] for i, p in enumerate(one)}
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[place[p]] = min(least.get(place[p], r[0]), r[0])
    want = Counter((r[0], f"{p:016x}", least.get(place[p])) for r, p in zip(rows, prints))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_simhash_tiles_and_other_widths(spark):
    import random

    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    values = {base}
    while len(values) < 300:  # one dense group, in one bucket for many keys
        values.add(base ^ sum(1 << b for b in rnd.sample(range(64), 3)))
    values |= {rnd.getrandbits(64) for _ in range(50)}
    signed = sorted(v - (v >> 63 << 64) for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for bits in (0, 2, 4):
        found = dict(map(tuple, components.components(simhash.close_links(fps, bits, chunk=16)).collect()))
        label = joined(len(signed), [(i, j) for i in range(len(signed)) for j in range(i)
                                     if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= bits])
        want = {v: signed[label[i]] for i, v in enumerate(signed) if label[i] != i}
        assert found == want


def test_simhash_stage(docs, none):
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    want = Counter(r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is None or r.doc_id == r.component_id)
    assert ids == want
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)] + [(500, 100 + i) for i in range(150)] + [(7, 7), (900, 901), (901, 900), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert {k for k in got if got[k] == 0} == set(range(1, 61))
    assert all(got[100 + i] == 100 for i in range(1, 150)) and got[500] == 100 and got[901] == 900


def key(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[key(r[1])].append(r)
    want = Counter()
    for k, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in g:
            same = r[0] == best[0] and len(r[1] or "") == len(best[1] or "")
            want[(r[0], best[0], len(g), same, hashlib.sha256(k.encode()).hexdigest())] += 1
    assert Counter(map(tuple, exactdedup.exact_duplicates(docs).collect())) == want
    left = exactdedup.without_copies(docs)
    assert left.columns == docs.columns
    assert Counter(key(r.text) for r in left.collect()) == Counter(groups.keys())
    assert exactdedup.exact_duplicates(none).count() == 0 and exactdedup.without_copies(none).count() == 0


def test_exact_with_a_full_filter(docs, monkeypatch):
    """Every row passes a filter that is too small; the result is the same."""
    want = Counter(map(tuple, exactdedup.exact_duplicates(docs).collect()))
    monkeypatch.setattr(exactdedup, "MIN_BITS", 64)
    monkeypatch.setattr(exactdedup, "MAX_BITS", 64)
    assert Counter(map(tuple, exactdedup.exact_duplicates(docs).collect())) == want


def plain_passages(rows):
    """By brute force over rows in the order of their ids."""
    def shingles(w):
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))

    met, texts = [], {}
    for d, t in rows:
        for k, line in enumerate((t or "").encode().lower().split(b"\n")):
            if w := tuple(line.split()):
                met.append((d, k, len(w), texts.setdefault(w, len(texts))))
    sets = [shingles(w) for w in texts]
    label = joined(len(sets), [(i, j) for i in range(len(sets)) for j in range(i)
                               if len(sets[i]) * 0.8 <= len(sets[j]) <= len(sets[i]) / 0.8 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    first, again = {}, defaultdict(list)
    for d, k, n, u in met:
        if first.setdefault(label[u], (d, k)) != (d, k):
            again[d].append((k, n, first[label[u]][0]))
    out = {}
    for d, _ in rows:
        runs = []
        for k, n, f in again[d]:
            if runs and runs[-1][1] == k - 1:
                runs[-1] = (runs[-1][0], k, runs[-1][2] + n, runs[-1][3] | {f})
            else:
                runs.append((k, k, n, {f}))
        long = [r for r in runs if r[2] >= 50]
        out[d] = ([r[:2] for r in long], sum(r[2] for r in long), sorted(set().union(*[r[3] for r in long])))
    return out


def test_passages(docs, rows, none):
    data = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0])
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = plain_passages(data)
    found = passages.repeated(one, chunk=8)
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.removed_words, r.first_docs) for r in found.collect()}
    assert got == want and any(w[0] for w in want.values())
    cut = {r.doc_id: r.text for r in passages.without_passages(one).collect()}
    for d, t in data:
        spans = want[d][0]
        keep = "\n".join(x for k, x in enumerate((t or "").split("\n")) if not any(a <= k <= b for a, b in spans))
        assert cut[d] == (keep if spans else t)
    every = passages.repeated(docs)
    assert Counter(r.doc_id for r in every.collect()) == Counter(r[0] for r in rows)
    assert passages.repeated(none).count() == 0


def test_bands_have_the_recall():
    number, size = passages.bands(0.8, 0.995)
    assert 1 - (1 - 0.8 ** size) ** number >= 0.995


def test_passages_over_blank_lines(spark):
    """Three paragraphs of 40 words are one passage, whatever blank lines part them."""
    parts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, "\n\n".join(parts)), (2, "own words\n" + "\n \n\n".join(parts) + "\n\nend"), (3, parts[0] + "\n\nother words here\n\n" + parts[1])]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.repeated_lines, r.removed_lines, r.removed_words, [tuple(s) for s in r.spans], r.first_docs) for r in passages.repeated(one).collect()}
    assert got == {1: (0, 0, 0, [], []), 2: (3, 7, 120, [(1, 7)], [1]), 3: (2, 0, 0, [], [])}
    assert {r.doc_id: r.text for r in passages.without_passages(one).collect()} == {1: rows[0][1], 2: "own words\n\nend", 3: rows[2][1]}


def plain_word_passages(rows, words=50):
    """Words whose run of that length stands before, by brute force."""
    seen, out = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        again, froms = set(), set()
        for i in range(len(w) - words + 1):
            first = seen.setdefault(tuple(w[i:i + words]), (d, i))
            if first != (d, i):
                again |= set(range(i, i + words))
                froms.add(first[0])
        at = sorted(again)
        starts, ends = [k for k in at if k - 1 not in again], [k for k in at if k + 1 not in again]
        out[d] = (list(zip(starts, ends)), len(at), sorted(froms))
    return out


def test_passages_within_lines(spark, docs, rows):
    import random

    rnd = random.Random(4)
    own = lambda n: " ".join(f"u{rnd.random()}" for _ in range(n))
    part, short = own(50), own(49)
    w = part.split()
    more = [(5001, f"{own(300)} {part} {own(9)}"), (5002, f"{own(7)} {part.upper()} {own(200)}"), (5003, f"{own(80)}\n{own(3)} " + " ".join(w[:20]) + "\n\n" + " ".join(w[20:]) + f" {own(4)}"),
            (5004, f"{own(30)} {short} {own(30)}"), (5005, f"{own(8)} {short} {own(8)}"), (5006, own(60) + " a b" * 40), (5007, part)]
    data = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]) + more
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    found = passages.repeated(one).cache()
    want = plain_word_passages(data)
    got = {r.doc_id: ([tuple(s) for s in r.passages], r.passage_words, r.passage_docs) for r in found.collect()}
    assert got == want
    assert want[5002] == ([(7, 56)], 50, [5001]) and want[5003] == ([(83, 132)], 50, [5001]) and want[5005][1] == 0 and want[5006][1] == 78
    assert {r.doc_id: r.component_id for r in found.collect() if r.doc_id > 5000} == {5001: 5001, 5002: 5001, 5003: 5001, 5004: 5004, 5005: 5005, 5006: 5006, 5007: 5001}
    cut = {r.doc_id: r.text for r in passages.without_passages(one, found, words=True).collect()}
    texts = dict(data)
    left = lambda d: [x for x in texts[d].split() if x.lower() not in w]
    assert cut[5001] == texts[5001] and all(cut[d].split() == left(d) for d in (5002, 5003, 5007))


def test_simhash_stage_decides_by_row(spark):
    """An unlike text that shares an id with a near copy stays; of several
    near copies with the smallest id one stays."""
    a = " ".join(f"w{i % 37}" for i in range(400))
    near, unlike = a + " w1", " ".join(f"x{i * i % 91}" for i in range(300))
    assert (plain_simhash(a) ^ plain_simhash(near)).bit_count() <= 4 < (plain_simhash(a) ^ plain_simhash(unlike)).bit_count()
    rows = [(1, a, "p"), (2, a, "q"), (2, unlike, "r"), (3, near, "s"), (None, a, "t"), (4, unlike, "u"), (1, near, "v")]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    assert sorted(r.label for r in left if r.label not in "pv") == ["r", "t"]
    assert sum(r.label in "pv" for r in left) == 1


def test_passages_of_many_tasks_and_repeated_ids(spark):
    """Rows are told apart whatever tasks they come from and ids they share."""
    import random

    rnd = random.Random(6)
    own = lambda n: " ".join(f"u{rnd.random()}" for _ in range(n))
    part = own(60)
    rows = [(i % 40, own(70) if i % 3 else f"{own(5)}\n{part}\n{own(5)}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    found = passages.repeated(df).cache()
    with_part = sum(part in t for _, t in rows)
    assert found.count() == 120 and found.where("removed_words = 60").count() == with_part - 1
    assert found.where("removed_words > 0").count() == with_part - 1   # no other row is reported
    left = passages.without_passages(df, found).collect()
    assert len(left) == 120 and sum(part in r.text for r in left) == 1
    assert Counter(r.doc_id for r in left) == Counter(r[0] for r in rows)
    alike = spark.createDataFrame([(1, part), (1, part), (1, part), (2, "own words")], "doc_id long, text string")
    assert sorted(r.text for r in passages.without_passages(alike).collect()) == ["", "", "own words", part]


def test_bands_with_the_same_texts_are_compared_once(spark):
    """Texts that are much alike share up to eight bands, whose tiles were all alike."""
    pairs = [(h, v) for v in range(8) for h in (5, 9)] + [(5, 20), (9, 20), (11, 20), (11, 21), (5, 22), (11, 22)]
    got = {tuple(r) for r in passages._shared(spark.createDataFrame(pairs, "h long, v long")).collect()}
    assert got == {(0, 2), (20, 3), (22, 2)}


def test_filter_bits_match_plain_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 20000)
    h, bits = np.concatenate((h, h[:3000])), 1 << 18
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for part in np.array_split(h, 5):
        exactdedup._note(part, once, twice)
    n = sum(np.bincount(pos.astype(np.int64), minlength=bits) for pos in exactdedup._positions(h, bits))
    assert np.array_equal(np.packbits(n > 0, bitorder="little"), once) and np.array_equal(np.packbits(n > 1, bitorder="little"), twice)
