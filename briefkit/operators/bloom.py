"""Bloom filter as a literal: keep the rows that may have one of given keys.

A join that keeps one row in a thousand should not shuffle the others.  The
keys' bits are set by an aggregate, the driver gets the words (``MAX_BITS`` at
most, whatever the keys), and the filter is a binary literal that the scan
tests, so only rows that may match reach the exchange.  What passes wrongly is
left to the join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key, probes, and bits of a filter at most (4 MB).
BITS, PROBES, MAX_BITS = 12, 3, 1 << 25


def _positions(hashes: list[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *hashes), F.lit(bits)) for i in range(PROBES)]


def may_hold(keys: DataFrame, *columns: str) -> Column:
    """Whether a row with these columns may have a key of ``keys``, which has
    the same columns; never false for one that has (NULL equals NULL)."""
    n = keys.count()
    if not n:
        return F.lit(False)
    bits = 64 * min(MAX_BITS // 64, math.ceil(n * BITS / 64))
    cols = [F.col(c) for c in columns]
    pos = keys.select(F.explode(F.array(*_positions(cols, bits))).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = pos.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    table = bytearray(bits // 8)
    for word, mask in words:
        table[8 * word:8 * word + 8] = (mask & (1 << 64) - 1).to_bytes(8, "little")
    data = F.lit(bytes(table))

    def hit(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, p.bitwiseAND(7).cast("int")) == 1

    found = hit(_positions(cols, bits)[0])
    for p in _positions(cols, bits)[1:]:
        found = found & hit(p)
    return found
