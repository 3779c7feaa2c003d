"""Texts that stand on both sides of a split: as they are, or in their shape.

The smaller side's fingerprints are put into a Bloom filter that is summed up by the tasks and sent to all; only rows of
the larger side that pass it are shuffled, and the join on the whole texts decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each key it holds, hash functions, and the most bits, whatever the keys: 8 MB.
PER_KEY, HASHES, MOST = 10, 4, 1 << 26
_LONG = 6  # 64 bits a long


def position(value: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits))


def bloom(keys: DataFrame, column: str) -> tuple[Column, int]:
    """A filter of the column's values, an array of longs in a scalar subquery, and its size in bits.

    More keys than ``MOST`` is made for let more rows pass than needed, and none be lost.
    """
    bits = 1 << min(MOST.bit_length() - 1, max(10, (keys.count() * PER_KEY).bit_length()))
    at = keys.select(F.explode(F.array(*(position(F.col(column), k, bits) for k in range(HASHES)))).alias("at"))
    one = F.expr(f"shiftleft(1L, cast(at & {(1 << _LONG) - 1} as int))")
    longs = at.select(F.shiftright("at", _LONG).alias("i"), one.alias("b"))
    # every place has a long, so that a place in the array is a place in the filter
    longs = longs.unionByName(keys.sparkSession.range(bits >> _LONG).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("b")))
    longs = longs.groupBy("i").agg(F.bit_or("b").alias("b"))
    return longs.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"])).scalar(), bits


def may_hold(filter_: Column, value: Column, bits: int) -> Column:
    """Whether the filter may hold the value; it never denies one that it holds."""
    held = F.lit(True)
    for k in range(HASHES):
        at = position(value, k, bits)
        held = held & (F.getbit(F.get(filter_, F.shiftright(at, _LONG).cast("int")), at.bitwiseAND(F.lit((1 << _LONG) - 1)).cast("int")) == 1)
    return held


def leaked(rows: DataFrame, other: DataFrame, key: str, text: Column) -> DataFrame:
    """The keys of ``rows`` whose ``text`` (an expression of columns that both have) some row of ``other`` has too.

    Null texts are in no two places at once. ``other`` should be the smaller side.
    """
    theirs = other.select(text.alias("_text")).where("_text IS NOT NULL").distinct()
    filter_, bits = bloom(theirs, "_text")
    proposed = rows.select(key, text.alias("_text")).where("_text IS NOT NULL").where(may_hold(filter_, F.col("_text"), bits))
    return proposed.join(theirs, "_text", "left_semi").select(key)
