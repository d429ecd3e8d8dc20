"""Prefix tries against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from briefkit.llm import prefixtrie


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}


def splice(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """{(depth, smallest member)...}: rows of every distinct beginning."""
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        own = (len(m) - 1) * (len(re.findall("[^ \t-\r]+", node[-1][1])) if node else 0)
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += own
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children.get(node, 0), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node)))).encode()).hexdigest())
                  for node, m in members.items())


def table(spark, rows):
    return spark.createDataFrame([(*r, b"x", 1) for r in rows], "conv_id long, turn long, role string, text string, t binary, pos int").repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def talk(n, seed=1):
    dice = random.Random(seed)
    rows = []
    for c in range(-30, n):
        rows += [(c, t, dice.choice(["user", "bot"]), dice.choice(["a", "b c", "", " \t"])) for t in range(dice.randint(0, 6))]
    return rows


def test_equals_brute_force(spark):
    rows = talk(200) + [(500 + i, t, "u", f"same words {t}") for i in range(120) for t in range(7)]  # copies
    rows += [(900, t, "u", f"long {t // 2}") for t in range(300)] + [(900 + i, t, "u", f"long {t // 2}") for i in (1, 2, 20) for t in range(250)]
    rows += [(41, None, None, "first"), (41, None, "u", None), (41, 0, "u", "x"), (41, 0, "u", "x"), (None, 1, "u", "x"), (43, 1, "é", "日本 " * 3000)]
    assert got(prefixtrie.spliced_trie(table(spark, rows))) == brute(splice(ordered(rows)))


@pytest.mark.parametrize("segment", [1, 3, 7])
def test_segments(spark, segment):
    """Paths cut into short segments give the same trie, also where a path
    ends with its segment."""
    rows = talk(80, 2) + [(300 + i, t, "u", f"w {t}") for i in range(9) for t in range(3 * i)]
    turns, convs = prefixtrie.numbered(table(spark, rows))
    convs = convs.unionByName(spark.createDataFrame([(7000, 0), (-7000, 0)], "conv_id long, n long"))
    want = brute({**ordered(rows), 7000: [], -7000: []})
    assert got(prefixtrie.prefix_trie(turns, convs, segment)) == want


def test_skeleton_nodes_and_shards(spark):
    """Nodes on splitter paths are finished by reduction only, others in one
    shard; whichever the splitters are, the rows are the same."""
    convs = splice(ordered(talk(60, 3)))
    keys = sorted((b"0" * 16 + b"".join(digest(*t) for t in p), c, [len(t[1].split()) for t in p]) for c, p in convs.items())
    skeleton = prefixtrie.Skeleton([k[:2] for k in keys[5::9]])
    assert [skeleton.depth[i] for i in range(len(skeleton.parent))][0] == 0
    assert all(p < i for i, p in enumerate(skeleton.parent))
    seen = defaultdict(set)
    for n, (key, c, words) in enumerate(keys):
        shard = prefixtrie.bisect_right(skeleton.splitters, (key, c))
        at = -1
        for i in range(0, len(key), 16):
            at = skeleton.child(at, key[i:i + 16])
            if at < 0:
                seen[key[:i + 16]].add(shard)
    assert seen and all(len(s) == 1 for s in seen.values())


def test_nothing(spark):
    assert got(prefixtrie.spliced_trie(table(spark, []))) == []
    assert got(prefixtrie.spliced_trie(table(spark, [(None, 1, "u", "x")]))) == []
    one = [(1, 5, "u", "only one")]
    assert got(prefixtrie.spliced_trie(table(spark, one))) == brute(splice(ordered(one)))
