"""Prefix trie of conversations by splitters and their skeleton.

A conversation is a path of turns (16 bytes of SHA-256 of role and text each).
Paths are sorted over the cluster between splitters taken from a sample, so the
members of a node, which share a beginning, are neighbours.  A node whose path
no splitter begins with has all its members between two splitters: the task of
that shard finishes it with one stack over its sorted paths.  The other nodes,
the prefixes of the splitters, are the skeleton, which every task knows; for
these a task gives partial counts, which are reduced by node and folded upwards
along the skeleton.  Equal paths are ordered by conversation, so copies of one
conversation are dealt over shards too.

Paths longer than ``SEGMENT`` turns are cut.  A later segment's trie stands
below the node where its first turn is missing; it is worked first, and what
its root has (children, leaves, tokens) is carried to that node.  So a row holds
``SEGMENT`` turns at most, the skeleton as many for each splitter, and a
conversation of any length takes one round more for each ``SEGMENT`` turns.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import global_rank
from .shared import prepare, stored

#: Turns of one row's path.
SEGMENT = 4096
#: Sampled rows for each splitter; ids of ended conversations in one row.
PER_SPLITTER, IDS = 20, 4096
#: Bytes of a turn in a path.
WIDTH = 16

NOTHING = hashlib.sha256(b"").hexdigest()
OUT = ("kind string, sid int, psid int, root binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
       "saved_tokens long, words long, x_children long, x_leaves long, x_saved long, first long, ends string")
NODE = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, t, w): place from 1, digest, words; and
    conversations (conv_id, n).  Numbering splits a long conversation over
    tasks too."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = stored(conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("t"), words.alias("w")), "turns")
    low = rows.agg(F.min("turn")).first()[0] or 0
    rows = rows.withColumn("at", F.coalesce(F.col("turn").cast("double"), F.lit(low - 1.0)))
    ranked = stored(global_rank(rows, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("t")], "rank", lead=[("conv_id", True), ("at", True)]), "ranked")
    starts = stored(ranked.groupBy("conv_id").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n")), "starts")
    turns = ranked.join(starts, "conv_id").select("conv_id", (F.col("rank") - F.col("start") + 1).alias("pos"), "t", "w")
    return turns, starts.select("conv_id", "n")


def spliced(turns: DataFrame, convs: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the one at the next
    lower multiple of ``every``, h being crc32 of the id modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = stored(heads.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "heads")
    turns = stored(turns, "numbered")
    own = turns.join(heads, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t", "w")
    first = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "t", "w")
    lent = heads.join(first, "base").where("pos <= h").select("conv_id", "pos", "t", "w")
    length = F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    return own.unionByName(lent), heads.select("conv_id", length.alias("n"))


def _segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """One row per segment of a path: conv_id, seg, root (16 bytes that stand
    for all before it), path, words, ends, next_root (null for the last).  A
    path that fills its segments has an empty one after them."""
    seg = F.floor((F.col("pos") - 1) / segment).cast("int")
    one = turns.withColumn("seg", seg).groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "t", "w"))).alias("s"))
    full = one.select("conv_id", "seg", F.unhex(F.array_join(F.transform("s.t", F.hex), "")).alias("path"), F.col("s.w").alias("words"))
    empty = convs.where(F.col("n") % segment == 0).select("conv_id", F.floor(F.col("n") / segment).cast("int").alias("seg"), F.unhex(F.lit("")).alias("path"),
                                                          F.array().cast("array<long>").alias("words"))
    rows = stored(full.unionByName(empty), "segments")
    if (rows.agg(F.max("seg")).first()[0] or 0) == 0:
        return rows.select("*", F.unhex(F.lit("00" * WIDTH)).alias("root"), F.lit(True).alias("ends"), F.lit(None).cast("binary").alias("next_root"))
    each = rows.select("conv_id", "seg", F.sha2("path", 256).alias("sha"))
    by = Window.partitionBy("conv_id").orderBy("seg")

    def chain(last: int):
        return F.unhex(F.substring(F.sha2(F.array_join(F.collect_list("sha").over(by.rowsBetween(Window.unboundedPreceding, last)), ""), 256), 1, 2 * WIDTH))

    each = each.select("conv_id", "seg", chain(-1).alias("root"), F.when(F.lead("seg").over(by).isNotNull(), chain(0)).alias("next_root"))
    length = F.col("seg").cast("long") * segment + F.size("words")
    out = rows.join(each, ["conv_id", "seg"]).join(convs, "conv_id")
    ends = (F.col("n") == length) & ((F.size("words") > 0) | (F.col("seg") == 0))
    return stored(out.withColumn("ends", ends).drop("n"), "chained")


class Skeleton:
    """The trie of the splitters' paths; nodes are numbered in preorder."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = sorted(splitters)
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kids: dict[int, dict[bytes, int]] = {}
        for key, _ in self.splitters:
            at = -1
            for i in range(0, len(key), WIDTH):
                at = self._child(at, key[i:i + WIDTH], i // WIDTH)

    def _child(self, at: int, turn: bytes, depth: int) -> int:
        kids = self.kids.setdefault(at, {})
        if turn not in kids:
            kids[turn] = len(self.parent)
            self.parent.append(at)
            self.depth.append(depth)
        return kids[turn]

    def child(self, at: int, turn: bytes) -> int:
        """The skeleton's node for a turn below node ``at``; -2 if none."""
        return self.kids[at].get(turn, -2) if at in self.kids else -2


class _Open:
    """A node whose members are still coming."""

    __slots__ = ("turn", "sid", "words", "n", "conv", "children", "leaves", "saved", "x", "kids", "ids", "first", "sha")

    def __init__(self, turn: bytes, sid: int, words: int):
        self.turn, self.sid, self.words = turn, sid, words
        self.n = self.children = self.leaves = self.saved = 0
        self.conv = self.first = self.sha = None
        self.x, self.kids, self.ids = (0, 0, 0), [], []


class _Walk:
    """One stack over a shard's sorted paths; ``out`` gets rows of OUT."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.stack, self.out = skeleton, [], []

    def row(self, kind: str, **have) -> None:
        self.out.append({"kind": kind} | have)

    def add(self, key: bytes, words, conv: int, ends: bool, x: tuple) -> None:
        turns = [key[i:i + WIDTH] for i in range(0, len(key), WIDTH)]
        same = 0
        for node, turn in zip(self.stack, turns):
            if node.turn != turn:
                break
            same += 1
        self.close(same)
        for i in range(same, len(turns)):
            at = self.stack[-1].sid if self.stack else -1
            self.stack.append(_Open(turns[i], self.skeleton.child(at, turns[i]), int(words[i - 1]) if i else 0))
        node = self.stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.x = x
        if ends:
            self.end(node, conv)

    def end(self, node: _Open, conv: int) -> None:
        if node.sid >= 0:
            node.ids.append(str(conv))
            if node.first is None:
                node.first = conv
            if len(node.ids) >= IDS:
                self.ids(node)
        elif node.sha is None:
            node.sha = hashlib.sha256(str(conv).encode())
        else:
            node.sha.update(f",{conv}".encode())

    def ids(self, node: _Open) -> None:
        if node.ids:
            self.row("ids", sid=node.sid, first=node.first, ends=",".join(node.ids))
        node.ids, node.first = [], None

    def close(self, depth: int) -> None:
        """Finish the nodes at ``depth`` and below it."""
        while len(self.stack) > depth:
            node, above = self.stack.pop(), self.stack[-1] if self.stack else None
            if above:
                above.n += node.n
                above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            if node.sid >= 0:
                self.ids(node)
                self.row("part", sid=node.sid, root=node.turn, conv_id=node.conv, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved,
                         words=node.words, x_children=node.x[0], x_leaves=node.x[1], x_saved=node.x[2])
                self.out += [kid | {"psid": node.sid} for kid in node.kids]
                continue
            children = node.children + node.x[0]
            leaves = node.leaves + node.x[1] + (children == 0)
            saved = node.saved + node.x[2] + (node.n - 1) * node.words
            done = {"kind": "node", "root": None if above else node.turn, "depth": len(self.stack), "conv_id": node.conv, "n_convs": node.n, "n_children": children,
                    "n_leaves": leaves, "saved_tokens": saved, "ends": node.sha.hexdigest() if node.sha else NOTHING}
            self.out += [kid | {"parent_conv_id": node.conv} for kid in node.kids]
            if above:
                above.children += 1
                above.leaves += leaves
                above.saved += saved
                above.kids.append(done)
            else:
                self.out.append(done)


def _splitters(rows: DataFrame, parts: int) -> list[tuple[bytes, int]]:
    """``parts - 1`` keys that cut a sample of bounded size evenly."""
    sample = rows.select("key", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(PER_SPLITTER * parts)
    place = Window.orderBy("key", "conv_id")
    cut = sample.withColumn("i", F.row_number().over(place)).where(F.col("i") % PER_SPLITTER == 0)
    return [(bytes(r.key), r.conv_id) for r in cut.collect()]


def _frames(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def _tries(rows: DataFrame, parts: int) -> DataFrame:
    """The nodes of one segment's tries: NODE and root (of nodes at depth 0).
    ``rows``: key (root and path), conv_id, words, ends, x_children, x_leaves,
    x_saved."""
    spark = rows.sparkSession
    skeleton = Skeleton(_splitters(rows, parts))
    shared = spark.sparkContext.broadcast(skeleton)

    @F.pandas_udf("int")
    def shard(key: pd.Series, conv: pd.Series) -> pd.Series:
        cuts = shared.value.splitters
        return pd.Series([bisect_right(cuts, (k, c)) for k, c in zip(key, conv)], dtype="int32")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, now = _Walk(shared.value), None
        for pdf in batches:
            for s, key, words, conv, ends, *x in pdf.itertuples(index=False):
                if s != now:
                    walk.close(0)
                    now = s
                walk.add(key, words, conv, ends, x)
                if len(walk.out) >= 4096:
                    yield _frames(walk.out)
                    walk.out = []
        walk.close(0)
        if walk.out:
            yield _frames(walk.out)

    dealt = rows.select(shard("key", "conv_id").alias("shard"), "key", "words", "conv_id", "ends", "x_children", "x_leaves", "x_saved")
    out = stored(dealt.repartition(parts, "shard").sortWithinPartitions("shard", "key", "conv_id").mapInPandas(local, OUT), "nodes")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One digest over a node's ids, however many rows they come in."""
        now, sha = None, None
        for pdf in batches:
            for sid, ids in zip(pdf["sid"], pdf["ends"]):
                if sid != now:
                    if now is not None:
                        yield pd.DataFrame({"sid": [now], "ends": [sha.hexdigest()]})
                    now, sha = sid, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if now is not None:
            yield pd.DataFrame({"sid": [now], "ends": [sha.hexdigest()]})

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From the last node in preorder to the first: children come before
        their parent, which adds up what they have."""
        tree, below = shared.value, {}
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                c, leaves, saved = below.pop(r.sid, (0, 0, 0))
                children = r.n_children + r.x_children + c
                leaves += r.n_leaves + r.x_leaves + (children == 0)
                saved += r.saved_tokens + r.x_saved + (r.n_convs - 1) * r.words
                above = tree.parent[r.sid]
                if above >= 0:
                    was = below.get(above, (0, 0, 0))
                    below[above] = was[0] + 1, was[1] + leaves, was[2] + saved
                rows.append({"kind": "node", "sid": r.sid, "psid": above if above >= 0 else None, "root": r.root if above < 0 else None, "depth": tree.depth[r.sid], "conv_id": r.conv_id,
                             "n_convs": r.n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": r.ends})
            yield _frames(rows)

    digests = out.where("kind = 'ids'").select("sid", "first", "ends").repartition("sid").sortWithinPartitions("sid", "first").mapInPandas(hashed, "sid int, ends string")
    total = out.where("kind = 'part'").groupBy("sid").agg(
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.max(c).alias(c) for c in ("words", "x_children", "x_leaves", "x_saved")], F.min("conv_id").alias("conv_id"), F.first("root").alias("root"))
    total = total.join(digests, "sid", "left").withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
    bones = stored(total.repartition(1).sortWithinPartitions(F.desc("sid")).mapInPandas(folded, OUT), "skeleton")
    above = bones.select(F.col("sid").alias("psid"), F.col("conv_id").alias("above"))
    nodes = out.where("kind = 'node'").unionByName(bones)
    return nodes.join(above, "psid", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select("root", *NODE)


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per distinct beginning of conversations: conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, pos (1 to n without gaps), t (16 bytes), w (words);
    ``convs`` has conv_id once, n (0 for a conversation without turns, which
    ends at the root).  A node's subtree includes itself; saved_tokens adds up
    (n_convs - 1) * words of the last turn over it; ends_sha256 is the SHA-256
    of the members' ids with just these turns, ascending, joined by commas.
    No conversations give no rows, not even a root."""
    spark = turns.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = _segments(turns, convs, segment)
    levels = (segments.agg(F.max("seg")).first()[0] or 0) + 1
    carry, found = None, None
    for k in reversed(range(levels)):
        rows = segments.where(F.col("seg") == k).withColumn("key", F.concat("root", "path"))
        extra = ("x_children", "x_leaves", "x_saved")
        if carry is not None:
            rows = rows.join(carry, "next_root", "left")
        for c in extra:
            rows = rows.withColumn(c, F.coalesce(c, F.lit(0)) if carry is not None else F.lit(0)).withColumn(c, F.col(c).cast("long"))
        nodes = stored(_tries(stored(rows.select("key", "conv_id", "words", "ends", *extra), "paths"), parts), "tries")
        leaves = F.col("n_leaves") - F.when(F.col("n_children") == 0, 1).otherwise(0)
        carry = nodes.where("depth = 0").select(F.col("root").alias("next_root"), F.col("n_children").alias("x_children"), leaves.alias("x_leaves"), F.col("saved_tokens").alias("x_saved"))
        nodes = nodes.where("depth > 0" if k else "true").withColumn("depth", F.col("depth") + k * segment)
        found = nodes if found is None else found.unionByName(nodes)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def spliced_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the spliced conversations (``spliced``, ``prefix_trie``).

    ``conversations`` has conv_id, turn, role, text.  Turns go by turn, null
    first, ties by the digest of role and text; repeated rows are turns of
    their own; null role or text is empty; rows without conv_id take no part;
    a text of any length is one digest; other columns are not read."""
    prepare(conversations.sparkSession)
    return prefix_trie(*spliced(*numbered(conversations)))
