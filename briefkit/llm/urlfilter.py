"""URL lists as cascades of Bloom filters.

A rule is a host and a path: it fits the urls of its host and all subdomains
whose path starts with the rule's.  So the keys under which a url may be listed
are the ends of its host and the beginnings of its path that are as long as
some rule's; the longest one listed decides.

Whether a key is listed is answered by a cascade: level 0 encodes the listed
keys, level 1 the keys of the corpus that level 0 takes for listed and are not,
level 2 the listed ones among those that level 1 takes, and so on until a level
takes nothing wrongly.  All keys of all urls take part in that (the complete
universe), so the answer is exact for each of them: a key is listed if the
first level that misses it is an odd one, or if none misses it and the last is
even.  No url meets the rules in a join.

Level 0 has ``log2(e) * log2(universe / listed)`` bits a key, which leaves about
as many false positives as there are listed keys.  A level has ``max_bits`` bits
at most; longer lists are dealt into shards by key, one pass over the urls for
each, so what is broadcast at once has a fixed bound.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stored

#: Bits of one level at most (16 MB).
MAX_BITS = 1 << 27
#: Bits a key and probes of the levels after the first; one in seven passes.
BITS, PROBES = 4, 3
#: Levels after which a cascade that still errs is given up (64 equal hashes).
MAX_LEVELS = 64


def host_path(url: str | Column = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and
    without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a url, in the order of ``shapes``: lengths of host and path."""
    n = F.length(host)

    def fits(s: Column) -> Column:
        whole = n == s["h"]
        inside = (s["h"] > 0) & (n > s["h"]) & (F.substring(host, n - s["h"], F.lit(1)) == ".")
        return (whole | inside) & (F.length(path) >= s["p"])

    def key(s: Column) -> Column:
        return F.struct(F.right(host, s["h"]).alias("host"), F.substring(path, F.lit(1), s["p"]).alias("path"))

    if not shapes:
        return F.expr("cast(array() as array<struct<host:string,path:string>>)")
    lengths = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in shapes])
    return F.transform(F.filter(lengths, fits), key)


def _hashes(host: Column, path: Column) -> tuple[Column, Column]:
    """128 bits of a key: two hashes that read it in either order."""
    return F.xxhash64(host, path), F.xxhash64(path, host)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(a: np.ndarray, b: np.ndarray, level: int, bits: int, probes: int) -> Iterator[np.ndarray]:
    """Bits of keys in a level: each level reads the hashes in its own way."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    a, b = _mix(a.astype(np.int64).view(np.uint64) + salt), _mix(b.astype(np.int64).view(np.uint64) ^ salt) | np.uint64(1)
    for k in range(probes):
        yield (a + np.uint64(k) * b) % np.uint64(bits)


class Level:
    """One Bloom filter of a cascade."""

    def __init__(self, number: int, words: np.ndarray, probes: int):
        self.number, self.words, self.probes = number, words, probes

    def takes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for pos in _positions(a, b, self.number, len(self.words) * 64, self.probes):
            out &= (self.words[pos >> np.uint64(6)] >> (pos & np.uint64(63))) & np.uint64(1) > 0
        return out


def listed(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed."""
    out, left = np.zeros(len(a), bool), np.arange(len(a))
    for level in levels:
        hit = level.takes(a[left], b[left])
        out[left[~hit]] = level.number % 2 == 1
        left = left[hit]
    out[left] = len(levels) % 2 == 1
    return out


def _build(keys: DataFrame, number: int, n: int, bits_per_key: float, probes: int, max_bits: int) -> Level:
    """A level that encodes ``keys``: tasks set words of bits, which are or-ed
    by word; the words of one level are all that the driver gets."""
    bits = 64 * min(max_bits // 64, max(1, math.ceil(n * bits_per_key / 64)))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pos = np.concatenate([*_positions(pdf["a"].to_numpy(), pdf["b"].to_numpy(), number, bits, probes)])
            word, back = np.unique(pos >> np.uint64(6), return_inverse=True)
            out = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(out, back, np.uint64(1) << (pos & np.uint64(63)))
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": out.view(np.int64)})

    got = keys.select("a", "b").mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(number, out, probes)


def _taken(df: DataFrame, *levels: Level) -> DataFrame:
    """The keys that any of the levels takes."""
    shared = df.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def taken(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.to_numpy(np.int64), b.to_numpy(np.int64)
        return pd.Series(np.logical_or.reduce([level.takes(a, b) for level in shared.value]))

    return df.where(taken("a", "b"))


def cascade(inside: DataFrame, outside: DataFrame, first: Level, max_bits: int = MAX_BITS) -> list[Level]:
    """The levels that tell the keys ``inside`` a list from those ``outside``,
    given its level 0; both tables hold distinct keys' hashes a, b."""
    levels, sets = [first], [stored(inside, "listed"), outside]
    while True:
        wrong = stored(_taken(sets[len(levels) % 2], levels[-1]), "wrong")
        n = wrong.count()
        if not n:
            return levels
        if len(levels) == MAX_LEVELS:
            raise ValueError("keys with equal hashes cannot be told apart")
        sets[len(levels) % 2] = wrong
        levels.append(_build(wrong, len(levels), n, BITS, PROBES, max_bits))


def _first_listed(spark, block: list[Level], allow: list[Level], shard: int, shards: int):
    """Column function of two arrays of hashes: 2 * place of the first key
    that a list holds, plus 1 if only the allowed one does; null if none."""
    shared = spark.sparkContext.broadcast((block, allow))

    @F.pandas_udf("int")
    def first(a: pd.Series, b: pd.Series) -> pd.Series:
        block, allow = shared.value
        size = np.array([len(x) for x in a], np.int64)
        row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b)]
        own = np.flatnonzero(flat[1].view(np.uint64) % np.uint64(shards) == shard)
        x, y = flat[0][own], flat[1][own]
        blocked, allowed = listed(block, x, y), listed(allow, x, y)
        hit = own[blocked | allowed]
        code = 2 * (hit - start[row[hit]]) + ~blocked[blocked | allowed]
        best = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(best, row[hit], code)
        return pd.Series(best).where(best < np.iinfo(np.int64).max).astype("Int32")

    return first


def _rules(rules: DataFrame) -> DataFrame:
    host = F.translate(F.coalesce("host", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    out = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    a, b = _hashes(F.col("host"), F.col("path"))
    return stored(out.withColumn("a", a).withColumn("b", b), "rules")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule
    (host and path of the longest rule that fits, null if none does), verdict
    (the rule's ``allow`` or ``block``; ``default`` where no key is listed).

    ``rules`` has host, path, verdict.  Longest is most characters, then the
    longer host; a rule both allowed and blocked blocks.  A url that is null or
    has no ``://`` has an empty host and path, which only a rule with both
    empty fits; a rule with an empty host fits no other host.  In rules null
    counts as empty, any other verdict is an error.  Repeated rows and null ids
    are judged row by row; a very long url has no more keys than rules have
    lengths; no rules or no pages give the default or no rows; other columns
    are not read."""
    spark = pages.sparkSession
    prepare(spark)
    rules = _rules(rules)
    if rules.where("verdict is null or verdict not in ('allow', 'block')").limit(1).count():
        raise ValueError("a rule's verdict is allow or block")
    lengths = rules.select(F.length("host").alias("h"), F.length("path").alias("p")).distinct().collect()
    shapes = sorted(((r.h, r.p) for r in lengths), key=lambda s: (-s[0] - s[1], -s[0]))
    host, path = host_path()
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", _keys(F.col("host"), F.col("path"), shapes))
    universe = urls.agg(F.sum(F.size("keys"))).first()[0] or 1
    n = {v: rules.where(F.col("verdict") == v).count() for v in ("allow", "block")}
    bits = {v: max(2 * BITS, math.log2(math.e) * math.log2(max(2, universe / max(1, n[v])))) for v in n}
    shards = max(1, *(math.ceil(n[v] * bits[v] / max_bits) for v in n))

    each = urls.select(F.explode("keys").alias("k")).select("k.*")
    a, b = _hashes(F.col("host"), F.col("path"))
    each = each.withColumn("a", a).withColumn("b", b)
    found = urls.withColumn("best", F.lit(None).cast("int"))
    for shard in range(shards):
        def own(df: DataFrame) -> DataFrame:
            return df.where(F.conv(F.hex("b"), 16, 10).cast("decimal(20,0)") % shards == shard) if shards > 1 else df

        lists = {v: own(rules.where(F.col("verdict") == v)) for v in n}
        first = {v: _build(lists[v], 0, lists[v].count(), bits[v], max(1, round(bits[v] * math.log(2))), max_bits) for v in n}
        met = _taken(own(each), *first.values()).groupBy("host", "path", "a", "b").agg(F.lit(False).alias("allow"), F.lit(False).alias("block"), F.lit(True).alias("met"))
        known = own(rules).select("host", "path", "a", "b", F.expr("verdict = 'allow'").alias("allow"), F.expr("verdict = 'block'").alias("block"), F.lit(False).alias("met"))
        keys = stored(met.unionByName(known).groupBy("host", "path", "a", "b")
                      .agg(*[F.bool_or(c).alias(c) for c in ("allow", "block", "met")]), "universe").where("met")
        levels = {v: cascade(keys.where(F.col(v)).select("a", "b"), keys.where(~F.col(v)).select("a", "b"), first[v], max_bits) for v in n}
        test = _first_listed(spark, levels["block"], levels["allow"], shard, shards)
        a = F.transform("keys", lambda k: _hashes(k["host"], k["path"])[0])
        b = F.transform("keys", lambda k: _hashes(k["host"], k["path"])[1])
        found = found.withColumn("best", F.least("best", test(a, b)))
        found = stored(found, "judged") if shards > 1 else found
    key = F.get("keys", F.floor(F.col("best") / 2).cast("int"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best") % 2 == 0, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.concat(key["host"], key["path"]).alias("rule"), verdict.alias("verdict"))
