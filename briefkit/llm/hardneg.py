"""Hard negatives by a multiway hyperplane tree of split points (GNAT).

Vectors are scaled to integers, so scores (inner products) are exact.  One
more coordinate, sqrt(M - |x|^2) for rows and 0 for anchors, turns a score into
a distance: |a - x|^2 = |a|^2 + M - 2 score, so a window of scores is an
annulus around the anchor.  A node of the tree has up to ``FAN`` split points;
a row goes to the nearest one.  For every split point and every sibling subtree
the tree holds the range of distances from the one to the rows of the other,
taken over all rows.  An anchor at distance d of a split point whose rows in a
sibling lie between lo and hi of it can only meet rows there at distances from
max(d - hi, lo - d) to d + hi; a sibling for which that misses the annulus is
passed over.  Leaves are compared exactly.

The tree is fitted on a bounded sample; every row is in a leaf.  Leaves are
dealt in parts of bounded rows (a larger leaf fills several), anchors in chunks;
a task compares one chunk with the leaves of one part that its anchors may
need, and gives back the best few of each window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, stored

#: Rows that the tree is fitted on, at most.
SAMPLE = 16384
#: Split points of a node, rows of a leaf aimed at, leaves at most.
FAN, LEAF, MAX_LEAVES = 8, 256, 4096
#: Rows of a part and anchors of a chunk.
PART, CHUNK = 32768, 8192
#: Rows compared at once, and pairs held before they are cut to the best.
BLOCK, HELD = 1024, 1 << 18

FAR = 1 << 62
ROW = "vec_id long, label long, q array<int>, leaf int, part int"
ASK = "anchor_id long, label long, q array<int>, positive array<long>, lo array<long>, lo_id array<long>, hi array<long>"


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null where a component is null,
    not finite, or so large that a score could pass a long."""
    top = F.least(F.lit(2.0**30), F.sqrt(F.lit(2.0**62) / F.greatest(F.lit(1), F.size(vector))))
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= top, F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def matrix(q: pd.Series, dim: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    if all(len(x) == dim for x in q):
        return np.array([*q], np.float64).reshape(len(q), dim)
    out = np.zeros((len(q), dim))
    for i, x in enumerate(q):
        out[i, :len(x)] = x
    return out


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products, as exact longs."""
    if a.size and x.size and np.abs(a).max() * np.abs(x).max() * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ x.astype(np.int64).T
    return (a @ x.T).astype(np.int64)


class Tree:
    """Split points, and the ranges of distances to the rows below them.

    ``nodes``: (split points, their last coordinate, children); a child is a
    node, or ~leaf.  ``lo``, ``hi``: [node][split point, child]."""

    def __init__(self, dim: int, most: float):
        self.dim, self.most, self.nodes, self.leaves = dim, most, [], 1
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []

    def last(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))

    def far(self, x: np.ndarray, last: np.ndarray, node: int) -> np.ndarray:
        """Distances of rows to the split points of a node."""
        p, p_last, _ = self.nodes[node]
        square = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T) + (last[:, None] - p_last) ** 2
        return np.sqrt(np.maximum(square, 0))

    def fit(self, x: np.ndarray, leaves: int) -> "Tree":
        """Split the fullest leaf until there are enough of them.  The split
        points of a node are its rows farthest from each other, of a few."""
        dice, last, held, parent = np.random.default_rng(42), self.last(x), {0: np.arange(len(x))}, {0: None}
        while self.leaves < leaves and held:
            leaf = max(held, key=lambda k: len(held[k]))
            rows = held.pop(leaf)
            some = rows[dice.permutation(len(rows))[:4 * FAN]]
            full = np.c_[x[some], last[some]]
            near, chosen = np.full(len(some), np.inf), [0] if len(some) else []
            while chosen and len(chosen) < min(FAN, leaves - self.leaves + 1):
                near = np.minimum(near, ((full - full[chosen[-1]]) ** 2).sum(1))
                if near.max() <= 0:
                    break
                chosen.append(int(near.argmax()))
            if len(chosen) < 2:
                continue  # all alike: it stays a leaf
            names = [leaf, *range(self.leaves, self.leaves + len(chosen) - 1)]
            self.leaves += len(chosen) - 1
            node, p = len(self.nodes), x[some[chosen]]
            if parent[leaf]:
                self.nodes[parent[leaf][0]][2][parent[leaf][1]] = node
            self.nodes.append((p, last[some[chosen]], [~k for k in names]))
            own = self.far(x[rows], last[rows], node).argmin(1)
            for c, name in enumerate(names):
                held[name], parent[name] = rows[own == c], (node, c)
        return self

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, last, todo = np.zeros(len(x), np.int64), self.last(x), [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            own = self.far(x[rows], last[rows], node).argmin(1)
            for c, child in enumerate(self.nodes[node][2]):
                if (part := rows[own == c]).size:
                    if child < 0:
                        out[part] = ~child
                    else:
                        todo.append((child, part))
        return out

    def above(self) -> list[list[tuple[int, int]]]:
        """Of each leaf, the (node, child) on its way from the root."""
        out: list[list] = [[] for _ in range(self.leaves)]
        todo = [(0, [])] if self.nodes else []
        while todo:
            node, way = todo.pop()
            for c, child in enumerate(self.nodes[node][2]):
                if child < 0:
                    out[~child] = [*way, (node, c)]
                else:
                    todo.append((child, [*way, (node, c)]))
        return out

    def met(self, a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """[anchor, leaf]: whether the leaf may hold rows with scores from lo
        to hi."""
        out = np.zeros((len(a), self.leaves), bool)
        if not self.nodes:
            return ~out
        base = (a * a).sum(1) + self.most
        most = np.sqrt(np.maximum(base - 2.0 * lo, 0)) * (1 + 1e-9) + 1e-6
        least = np.sqrt(np.maximum(base - 2.0 * hi, 0)) * (1 - 1e-9) - 1e-6
        todo = [(0, np.arange(len(a)))]
        while todo:
            node, rows = todo.pop()
            p, _, children = self.nodes[node]
            d = np.sqrt(np.maximum(base[rows, None] + 0.0 - 2 * (a[rows] @ p.T), 0))[:, :, None]
            nearest = np.maximum(d - self.hi[node], self.lo[node] - d).max(1)
            farthest = (d + self.hi[node]).min(1)
            go = (nearest <= most[rows, None]) & (farthest >= least[rows, None])
            for c, child in enumerate(children):
                if (some := rows[go[:, c]]).size:
                    if child < 0:
                        out[some, ~child] = True
                    else:
                        todo.append((child, some))
        return out


def _ranges(rows: DataFrame, tree: Tree) -> None:
    """Fill in the ranges of distances, over all rows; the driver gets one row
    for each pair of siblings."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    tree.lo = [np.full((len(n[2]),) * 2, np.inf) for n in tree.nodes]
    tree.hi = [np.full((len(n[2]),) * 2, -np.inf) for n in tree.nodes]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, found = shared.value, {}
        ways = t.above()
        for pdf in batches:
            x = matrix(pdf["q"], t.dim)
            last, leaf = t.last(x), pdf["leaf"].to_numpy()
            of: dict[tuple, list] = {}
            for k in np.unique(leaf):
                at = np.flatnonzero(leaf == k)
                for step in ways[k]:
                    of.setdefault(step, []).append(at)
            for step, ats in of.items():
                at = np.concatenate(ats)
                d = t.far(x[at], last[at], step[0])
                lo, hi = found.get(step, (np.inf, -np.inf))
                found[step] = np.minimum(lo, d.min(0)), np.maximum(hi, d.max(0))
        for (node, child), (lo, hi) in found.items():
            yield pd.DataFrame({"node": node, "child": child, "point": range(len(lo)), "lo": lo, "hi": hi})

    each = rows.select("q", "leaf").mapInPandas(local, "node int, child int, point int, lo double, hi double")
    for r in each.groupBy("node", "child", "point").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().itertuples():
        tree.lo[r.node][r.point, r.child], tree.hi[r.node][r.point, r.child] = r.lo, r.hi


class Index:
    """All rows by leaf and part, stored, and the tree over them."""

    def __init__(self, vectors: DataFrame, leaf: int = LEAF, part: int = PART):
        spark = vectors.sparkSession
        once = stored(vectors.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q"), "vectors")
        norm = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        n, dim, most = once.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(norm)).first()
        self.tree = tree = Tree(dim or 0, float(most or 0))
        sample = once.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").toPandas()["q"]
        tree.fit(matrix(sample, tree.dim), min(MAX_LEAVES, max(1, math.ceil(n / leaf))))
        shared = spark.sparkContext.broadcast(tree)

        @F.pandas_udf("int")
        def leaf_of(q: pd.Series) -> pd.Series:
            return pd.Series(shared.value.leaf_of(matrix(q, shared.value.dim)))

        placed = stored(once.withColumn("leaf", leaf_of("q")), "placed")
        # leaves in parts: several small ones share one, a large one fills several
        size = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        part = max(1, min(part, math.ceil(n / (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))) if n > 2 * BLOCK else part))
        self.parts, free, filled = {}, 0, 0
        for k in range(tree.leaves):
            need = size.get(k, 0)
            if filled and filled + need > part:
                free, filled = free + 1, 0
            many = max(1, math.ceil(need / part))
            self.parts[k] = (free, many)
            free, filled = (free + many, 0) if many > 1 else (free, filled + need)
        table = spark.createDataFrame([(k, *v) for k, v in self.parts.items()], "leaf int, first int, many int")
        pick = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many")).cast("int")
        self.rows = stored(placed.join(F.broadcast(table), "leaf").select("vec_id", "label", "q", "leaf", pick.alias("part")), "rows")
        _ranges(self.rows, tree)

    def search(self, asks: DataFrame, k: int, same: bool, own_leaf: bool = False) -> DataFrame:
        """The first ``k`` rows of each window: anchor_id, positive, score,
        vec_id, rank.  ``asks`` has the columns of ASK; a window takes scores
        from lo (at lo itself only ids up to lo_id) to hi, of the anchor's
        label or of others, and never the anchor.  ``own_leaf``: only in the
        anchors' own leaves."""
        tree, parts = self.tree, self.parts
        shared = asks.sparkSession.sparkContext.broadcast((tree, parts))
        chunks = max(1, math.ceil(asks.count() / CHUNK))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t, places = shared.value
            of = [range(f, f + m) for f, m in (places[x] for x in range(t.leaves))]
            for pdf in batches:
                a = matrix(pdf["q"], t.dim)
                if own_leaf:
                    go = np.zeros((len(a), t.leaves), bool)
                    go[np.arange(len(a)), t.leaf_of(a)] = True
                else:
                    size = np.array([len(x) for x in pdf["lo"]], np.int64)
                    row = np.repeat(np.arange(len(a)), size)
                    flat = [np.concatenate([np.zeros(0), *pdf[c]]) for c in ("lo", "hi")]
                    go = np.zeros((len(a), t.leaves), bool)
                    for s in range(0, len(row), 1024):
                        some = row[s:s + 1024]
                        np.logical_or.at(go, some, t.met(a[some], flat[0][s:s + 1024], flat[1][s:s + 1024]))
                rows, leaves, at = [], [], []
                for i, hit in enumerate(go):
                    by: dict[int, list[int]] = {}
                    for x in np.flatnonzero(hit):
                        for p in of[x]:
                            by.setdefault(p, []).append(int(x))
                    rows += [i] * len(by)
                    at += by.keys()
                    leaves += by.values()
                for s in range(0, len(rows), 4096):
                    yield pdf.iloc[rows[s:s + 4096]].assign(leaves=leaves[s:s + 4096], part=at[s:s + 4096])

        def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            return _best(rows, asked, tree_dim, k, same)

        tree_dim = tree.dim
        sent = asks.select(*[c.split()[0] for c in ASK.split(", ")]).mapInPandas(route, f"{ASK}, leaves array<int>, part int")
        sent = sent.withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).cast("int"))
        rows = self.rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        met = rows.groupBy("part", "chunk").cogroup(sent.groupBy("part", "chunk")) \
            .applyInPandas(compare, "anchor_id long, positive long, score long, vec_id long")
        order = Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(rows: pd.DataFrame, asked: pd.DataFrame, dim: int, k: int, same: bool) -> pd.DataFrame:
    """The best rows of one part for the windows of one chunk of anchors."""
    if not len(rows) or not len(asked):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "positive", "score", "vec_id")})
    rows = rows.sort_values(["leaf", "vec_id"])
    x, ids, label, leaf = matrix(rows["q"], dim), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["leaf"].to_numpy()
    a, anchor, a_label = matrix(asked["q"], dim), asked["anchor_id"].to_numpy(), asked["label"].to_numpy()
    size = np.array([len(w) for w in asked["lo"]], np.int64)
    own = np.repeat(np.arange(len(a)), size)  # a window's anchor
    lo, lo_id, hi = (np.concatenate([np.zeros(0, np.int64), *asked[c]]).astype(np.int64) for c in ("lo", "lo_id", "hi"))
    positive = [p for w in asked["positive"] for p in w]
    wants = np.zeros((len(a), 1 + int(leaf.max())), bool)
    for i, some in enumerate(asked["leaves"]):
        wants[i, [s for s in some if s < wants.shape[1]]] = True
    held = [np.zeros((0, 3), np.int64)]

    def cut() -> None:
        """Keep the first k of each window; the k-th bounds what may follow."""
        w, s, v = np.concatenate(held).T
        order = np.lexsort((v, -s, w))
        w, s, v = w[order], s[order], v[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        full = rank == k - 1
        lo[w[full]], lo_id[w[full]] = s[full], v[full]
        held[:] = [np.c_[w, s, v][rank < k]]

    for start in np.r_[0, np.flatnonzero(np.diff(leaf)) + 1]:
        stop = np.searchsorted(leaf, leaf[start], "right")
        for b in range(start, stop, BLOCK):
            at = slice(b, min(stop, b + BLOCK))
            windows = np.flatnonzero(wants[own, leaf[start]])
            for t in range(0, len(windows), BLOCK):
                w = windows[t:t + BLOCK]
                who, back = np.unique(own[w], return_inverse=True)
                score = products(a[who], x[at])[back]
                fine = (score <= hi[w, None]) & ((score > lo[w, None]) | (score == lo[w, None]) & (ids[at] <= lo_id[w, None]))
                fine &= (label[at] == a_label[own[w], None]) == same
                fine &= ids[at] != anchor[own[w], None]
                i, j = np.nonzero(fine)
                held.append(np.c_[w[i], score[i, j], ids[at][j]])
            if sum(map(len, held)) > HELD:
                cut()
    cut()
    w, s, v = held[0].T
    return pd.DataFrame({"anchor_id": anchor[own[w]], "positive": pd.array([positive[i] for i in w], "Int64"), "score": s, "vec_id": v})


def hard_negatives(vectors: DataFrame, anchors: Column, scale: float = 256, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding, label; ``anchors`` says which rows are
    anchors.  Positives are the first ``positives`` other rows of the anchor's
    label by score, then smaller id; negatives the first ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * negative_score <=
    high * positive_score``.

    Rows without an id, label or vector, with a component that is null or not
    finite, or with one so large that a score could pass a long, take no part.
    Rows that repeat an id count once (smallest label, then components); equal
    vectors are ties, won by the smaller id; a shorter vector counts as filled
    up with zeros.  A negative score has no window.  An empty table gives no
    rows; other columns are not read."""
    spark = vectors.sparkSession
    prepare(spark)
    q = scaled(F.col("embedding"), scale)
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), q.alias("q"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")) \
        .where("vec_id is not null and label is not null and q is not null")
    index = Index(rows.select("vec_id", "label", "q"), leaf, part)
    chosen = rows.where("is_anchor").select("vec_id").distinct()
    chosen = stored(index.rows.join(chosen, "vec_id", "left_semi").select(F.col("vec_id").alias("anchor_id"), "label", "q"), "anchors")

    def ask(df: DataFrame, lo: Column, lo_id: Column) -> DataFrame:
        """One window without a ceiling for each anchor."""
        return df.select("anchor_id", "label", "q", F.array(F.lit(None).cast("long")).alias("positive"), F.array(lo.cast("long")).alias("lo"),
                         F.array(lo_id.cast("long")).alias("lo_id"), F.array(F.lit(FAR)).alias("hi"))

    # what the own leaf holds bounds the score of the last positive from below
    near = index.search(ask(chosen, F.lit(-FAR), F.lit(FAR)), positives, same=True, own_leaf=True)
    near = near.where(F.col("rank") == positives).select("anchor_id", F.col("score").alias("lo"), F.col("vec_id").alias("lo_id"))
    bounded = stored(chosen.join(near, "anchor_id", "left"), "bounded")
    found = index.search(ask(bounded, F.coalesce("lo", F.lit(-FAR)), F.coalesce("lo_id", F.lit(FAR))), positives, same=True)
    found = stored(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    bottom, top = F.ceil(F.col("positive_score").cast("decimal(38,0)") * low / 100), F.floor(F.col("positive_score").cast("decimal(38,0)") * high / 100)
    windows = found.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct(
        F.col("positive_id").alias("p"), bottom.cast("long").alias("lo"), top.cast("long").alias("hi"))).alias("w"))
    asks = chosen.join(windows, "anchor_id").select("anchor_id", "label", "q", F.col("w.p").alias("positive"), F.col("w.lo").alias("lo"),
                                                    F.transform("w", lambda _: F.lit(FAR)).alias("lo_id"), F.col("w.hi").alias("hi"))
    hard = index.search(stored(asks, "windows"), negatives, same=False)
    hard = hard.select("anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(found, ["anchor_id", "positive_id"]) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
