"""Archives, fingerprints and mixing against brute force."""

import base64
import gzip
import hashlib
import math
from collections import Counter, defaultdict

import pytest

from briefkit.llm import iblt, mixing, warc
from briefkit.session import scratch_path

PAGES = [(3, "http://a/1", "<p>one</p>"), (1, "http://a/\n2", "<p>one</p>"), (2, None, None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
         (6, "u", "é日本" * 4000), (None, "u", "<p>one</p>"), (7, "u", "own"), (7, "u", "own"), (8, None, "<p>one</p>")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, first string")


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_of_pages(spark, least):
    path = scratch_path(spark, "warc")
    warc.write_pages(pages(spark), path, least=least)
    found = warc.read_archives(spark, path).collect()
    assert all(r.kind == "record" for r in found)
    first = defaultdict(list)
    for p, _, h in PAGES:
        first[h or ""].append(p)
    want = Counter()
    for p, _, h in PAGES:
        h = h or ""
        top = min((x for x in first[h] if x is not None), default=None)
        again = len(first[h]) > 1 and p != top and len(h.encode()) >= least
        want[(f"<urn:page:{'' if p is None else p}>", len(h.encode()), sha(h.encode()), "revisit" if again else "response",
              f"<urn:page:{top}>" if again else None, None if again else h)] += 1
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in found) == want


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_pages(pages(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


def record(n, body=b"payload"):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{sha(body)}\r\nWARC-Block-Digest: sha1:{sha(http)}\r\n"
            f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n").encode() + http + b"\r\n\r\n"


def summary(data):
    return [(kind, start, stop, x.head["warc-record-id"] if kind == "record" else "") for kind, start, stop, x in warc.salvage(data)]


def test_salvage_of_plain_archives():
    a, b, c = record(1), record(2, b"WARC/1.1\r\n inside " * 9), record(3)
    whole = a + b + c
    cuts = [0, len(a), len(a) + len(b), len(whole)]
    ids = ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    assert summary(whole) == [("record", cuts[i], cuts[i + 1], ids[i]) for i in range(3)]
    flipped = bytearray(whole)
    flipped[cuts[2] - 10] ^= 1  # in the second record's payload
    assert summary(bytes(flipped)) == [("record", 0, cuts[1], ids[0]), ("gap", cuts[1], cuts[2], ""), ("record", cuts[2], cuts[3], ids[2])]
    lost = a + b[:40] + c
    assert summary(lost) == [("record", 0, cuts[1], ids[0]), ("gap", cuts[1], cuts[1] + 40, ""), ("record", cuts[1] + 40, len(lost), ids[2])]
    assert summary(b"junk" + a + b"tail") == [("gap", 0, 4, ""), ("record", 4, 4 + len(a), ids[0]), ("gap", 4 + len(a), 8 + len(a), "")]
    assert summary(a[:-3]) == [("gap", 0, len(a) - 3, "")] and summary(b"") == []


def test_salvage_of_gzip_members(spark, tmp_dir):
    members = [gzip.compress(record(n)) for n in range(4)]
    damaged = bytearray(members[1])
    damaged[len(damaged) // 2] ^= 0xFF
    data = members[0] + bytes(damaged) + members[2] + members[3][:30]
    at = [0, len(members[0]), len(members[0]) + len(damaged), len(data) - 30, len(data)]
    assert summary(data) == [("record", 0, at[1], "<urn:page:0>"), ("gap", at[1], at[2], ""), ("record", at[2], at[3], "<urn:page:2>"), ("gap", at[3], at[4], "")]
    with open(f"{tmp_dir}/x.warc.gz", "wb") as f:
        f.write(data)
    got = warc.read_archives(spark, tmp_dir).orderBy("start").collect()
    assert [(r.kind, r.start, r.stop) for r in got] == [x[:3] for x in summary(data)]
    assert got[1].reason and got[1].payload is None and bytes(got[0].payload) == b"payload"


def likeness(a, b):
    x, y = (set(Counter(t.split("\n")).items()) for t in (a, b))
    return round(len(x & y) / len(x | y), 9)


def check_prints(rows, found):
    want = Counter()
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + n[:third]
        want[(d, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, n))] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found)
    assert got == want


def test_fingerprints(docs, rows, none, spark):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = iblt.fingerprints(one).collect()
    data = {r[0]: r[1] for r in rows if r[0] is not None}
    check_prints(list(data.items()), found)
    by_text = defaultdict(set)
    for r in found:
        by_text[data[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert Counter(r.doc_id for r in iblt.fingerprints(docs).collect()) == Counter(r[0] for r in rows)
    assert iblt.fingerprints(none).count() == 0
    check_prints([(5, "only\none")], iblt.fingerprints(spark.createDataFrame([(5, "only\none")], "doc_id long, text string")).collect())


def test_peeling_is_retried(spark, monkeypatch):
    """With far too few cells the first attempts fail; the result is whole."""
    monkeypatch.setattr(iblt, "LOAD", 400)
    a, b = list(range(0, 300)), list(range(150, 420))
    keys = spark.createDataFrame([(1, a, b), (2, a, a), (3, [], [7])], "id long, a array<bigint>, b array<bigint>")
    got = {r.id: r.d for r in iblt.differences(keys, {"d": ("a", "b")}).collect()}
    assert got == {1: 270, 3: 1}


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess, round by round."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | t
        full |= {s: most * sizes[s] for s in over}


def test_mix(docs, rows, none):
    found = mixing.mix(docs).collect()
    words = Counter((r[0], r[3], len((r[1] or "").encode().split())) for r in rows)
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == words
    sizes = defaultdict(int)
    for (_, s, n), k in words.items():
        sizes[s] += n * k
    want = shares(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 and -1e-9 <= r.rate <= 3
        taken[r.source] += r.taken
    least = max(n for (_, _, n) in words)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 30) or least > t / 10
    assert Counter(map(str, found)) == Counter(map(str, mixing.mix(docs.repartition(7)).collect()))
    made = mixing.mixed(docs)
    assert made.columns == docs.columns and made.count() == sum(r.copies for r in found)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    empty = docs.selectExpr("doc_id", "cast(null as string) as text", "source")
    assert {r.taken for r in mixing.mix(empty).collect()} == {0}


def test_duals_solve_the_constraints(docs):
    """Each source that is not at its limit: rates min(3, exp(dual * x)) give
    the target, by bisection in plain Python."""
    found = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
    for rs in by.values():
        total, target = rs[0].source_size, rs[0].target
        if not total or target >= 3 * total:
            continue
        mean = total / len(rs)
        lo, hi = -1e4, 1e4
        rate = lambda d, n: 3.0 if d * n / mean >= math.log(3) else math.exp(d * n / mean)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(r["size"] * rate(mid, r["size"]) for r in rs) < target else (lo, mid)
        for r in rs:
            assert r.rate == pytest.approx(rate(lo, r["size"]) if r["size"] else 1.0, abs=1e-4)


def test_targets_far_above_a_source(spark):
    rows = [(i, "w " * 10, "a") for i in range(4)] + [(10 + i, "w " * 20, "b") for i in range(300)] + [(999, "", "c")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {s: (sum(r.taken for r in found if r.source == s), next(r.target for r in found if r.source == s)) for s in "abc"}
    assert by["a"] == (120, 120.0) and by["c"] == (0, 0.0) and abs(by["b"][0] - by["b"][1]) <= 20


def test_gzip_members_cost_their_own_length():
    """4,000 members; a damaged one among them, and false beginnings of
    members in the gap, are passed over."""
    import time

    members = [gzip.compress(record(n, b"p" * 5000 + bytes([n % 251]) * 4000)) for n in range(4000)]
    began = time.time()
    assert sum(kind == "record" for kind, *_ in warc.salvage(b"".join(members))) == 4000
    assert time.time() - began < 20
    members[7] = members[7][:40] + b"\x1f\x8b\x08" * 3000 + members[7][60:]
    found = [kind for kind, *_ in warc.salvage(b"".join(members[:20]))]
    assert found.count("record") == 19 and found.count("gap") == 1


def test_archives_are_bounded_by_bytes(spark):
    sizes = [10] * 40 + [3000] * 12 + [60_000] * 3 + [400_000]
    rows = [(i, "u", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)]
    path = scratch_path(spark, "warc")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, records=64, size=64_000)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert max(f.length for f in files) < 410_000 and sorted(f.length for f in files)[-2] < 64_000 + 64 * 700
    back = {int(r.record_id[10:-1]): bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
    assert back == {i: h for i, _, h in rows}


def test_the_query_fails_on_bytes_it_cannot_read(spark, monkeypatch, tmp_path):
    from briefkit.llm import queries

    write = warc.write_pages

    def damaged(pages, path):
        write(pages, path)
        spark.createDataFrame([("no record",)], "value string").coalesce(1).write.mode("append").text(path)
    monkeypatch.setattr(queries.warc, "write_pages", damaged)
    with pytest.raises(Exception, match="unreadable bytes"):
        queries.op8_warc(spark, "/root/testdata/sf0.001").collect()
